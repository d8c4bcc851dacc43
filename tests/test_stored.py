"""Stored pages, digests and partial totals."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import checks, rules, totals, views
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean
from ledgerspark.sinks import digests, pages
from ledgerspark.sinks.staging import stage
from ledgerspark.sources import exports, headers
from tests import sample
from tests.test_intake import write_csv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def partition_filters(df):
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().head()
    return scan.metadata().apply("PartitionFilters")


@pytest.fixture
def numbers(spark):
    # ties on the first key, and nulls
    return spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("k"))


def test_pages_are_those_of_the_sorted_table(spark, tmp_path, numbers):
    order = [F.col("k").desc_nulls_last(), F.col("id").asc()]
    path = str(tmp_path / "pages")
    pages.write_pages(numbers, order, path, part_rows=90)
    assert pages.page_count(spark, path, 64) == 16
    for n in (0, 1, 7, 15, 16):
        got = pages.read_page(spark, path, n, 64)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in views.page(numbers, order, n, 64).collect()]
    assert "_part" in partition_filters(pages.read_page(spark, path, 15, 64))
    with pytest.raises(ValueError):
        pages.read_page(spark, path, -1)


def test_pages_of_an_empty_table(spark, tmp_path, numbers):
    path = str(tmp_path / "pages")
    pages.write_pages(numbers.limit(0), [F.col("id").asc()], path)
    assert pages.page_count(spark, path) == 0
    assert pages.read_page(spark, path, 0).count() == 0


ROWS = [(1, "a", None), (2, None, "a"), (3, "b", "c"), (3, "b", "c"), (4, None, None)]
SCHEMA = "id long, x string, y string"


@pytest.mark.parametrize(
    "other",
    [
        ROWS, ROWS[::-1], [], ROWS[:-1], [*ROWS, (3, "b", "c")],
        # values that trade places with nulls
        [(1, None, "a"), *ROWS[1:]], [*ROWS[:4], (None, None, None)],
    ],
)
def test_digest_diff_is_the_diff_of_the_rows(spark, tmp_path, other):
    a, b = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(other, SCHEMA)
    stored = digests.write_digested(str(tmp_path / "a"), a, ["id"], 4)
    again = digests.read_digested(spark, str(tmp_path / "a"))
    for right in (digests.digested(b, ["id"], 4), digests.write_digested(str(tmp_path / "b"), b, ["id"], 4)):
        got = digests.digest_diff(again, right)
        assert sorted(map(str, got.collect())) == sorted(map(str, checks.ledger_diff(a, b).collect()))
        verdict = digests.check_same_digested(stored, right, "same").head()
        assert verdict["ok"] == (sorted(map(str, ROWS)) == sorted(map(str, other)))


def test_only_buckets_that_differ_are_read(spark, tmp_path, numbers):
    a = digests.write_digested(str(tmp_path / "a"), numbers, ["id"], 16)
    changed = numbers.withColumn("k", F.when(F.col("id") == 7, 9).otherwise(F.col("k")))
    b = digests.write_digested(str(tmp_path / "b"), changed, ["id"], 16)
    assert len(digests.differing_buckets(a, b)) == 1
    diff = digests.digest_diff(a, b)
    assert {(r["k"], r["only_in"]) for r in diff.collect()} == {(None, "a"), (9, "b")}
    assert "_bucket" in partition_filters(diff)
    # of equal tables no file of rows is in the plan
    assert "Scan parquet" not in plan(digests.digest_diff(a, digests.write_digested(str(tmp_path / "c"), numbers, ["id"], 16)))
    with pytest.raises(ValueError):
        digests.differing_buckets(a, digests.digested(numbers, ["id"], 8))
    with pytest.raises(ValueError):
        digests.differing_buckets(a, digests.digested(numbers.select("id"), ["id"], 16))


def lines(df):
    return sorted(map(str, df.select("section", "place", "ord", "label", "cents", "rows", "note").collect()))


@pytest.mark.parametrize("months", [None, ("2025-12", "2026-08")])
@pytest.mark.parametrize("top_n", [None, 3])
def test_summary_from_merged_totals(spark, tmp_path, months, top_n):
    records = stage(clean(sample.source_rows(spark), rules.builtin_rules(spark)), str(tmp_path / "records"))
    wanted = lines(reports.report_summary(records, 250_000, months, top_n))
    whole = stage(totals.partial_totals(records, 250_000), str(tmp_path / "whole"))
    assert lines(reports.summary_of_totals(whole, months, top_n)) == wanted
    # a part without records takes no part
    cut = [F.col("source_row") % 3 == 0, F.col("source_row") % 3 != 0, F.lit(False)]
    parts = [totals.partial_totals(records.filter(c), 250_000) for c in cut]
    merged = stage(totals.merge_totals(parts), str(tmp_path / "merged"))
    assert lines(reports.summary_of_totals(merged, months, top_n)) == wanted


def test_totals_of_no_records(spark, tmp_path):
    records = clean(sample.source_rows(spark).limit(0), rules.builtin_rules(spark))
    partial = stage(totals.partial_totals(records, 1), str(tmp_path / "totals"))
    assert lines(reports.summary_of_totals(partial)) == lines(reports.report_summary(records, 1))


def test_large_sums_stay_exact(spark, tmp_path):
    line = ("status", "clean", None, None, Decimal(10**20), 1, 0, 0)
    some = clean(sample.source_rows(spark), rules.builtin_rules(spark))
    schema = totals.partial_totals(some, 1).schema
    partial = spark.createDataFrame([line, ("month", "2025-01", *line[2:]), ("merchant", "A", *line[2:])], schema)
    got = {(r["section"], r["label"]): r["cents"] for r in reports.summary_of_totals(totals.merge_totals([partial, partial])).collect()}
    assert got[0, "Retained bills"] == got[1, "2025-01"] == got[3, "A"] == 2 * 10**20


def test_records_are_scanned_once(spark, tmp_path):
    records = stage(clean(sample.source_rows(spark), rules.builtin_rules(spark)), str(tmp_path / "records"))
    assert plan(totals.partial_totals(records, 1)).count("FileScan") == 1


BAD = [["Invoice", "Vendor", "Date", "Amount"], ["a", "Shop", "2026-05-04", "1.00", "outside"], ["b", "Shop", "2026-05-04", "2.00"]]


@pytest.mark.parametrize("mode", ["strict", "words"])
@pytest.mark.parametrize("files", [["good"], ["bad", "good"], ["none", "bad"], ["empty"]])
def test_settled_imports_decide_as_read_ones(spark, tmp_path, mode, files):
    made = {"good": [BAD[0], BAD[2]], "bad": BAD, "none": [["x", "y"], ["1", "2"]], "empty": [BAD[0]]}
    paths = [write_csv(tmp_path / f"{name}.csv", made[name]) for name in files]
    intake = headers.map_headers(exports.read_csv_exports(spark, paths), mode=mode)

    def outcome(read):
        try:
            return sorted(map(str, read().collect()))
        except ValueError as error:
            return str(error)

    assert outcome(lambda: intake.settle(str(tmp_path / "once")).rows) == outcome(intake.or_fail)
    kept = intake.settle(str(tmp_path / "quarantine"), quarantine=True)
    for a, b in ((kept.rows, intake.rows), (kept.rejects, intake.rejects), (kept.sheets, intake.sheets)):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_nothing_to_settle(spark, tmp_path):
    cells = exports.read_csv_exports(spark, [write_csv(tmp_path / "a.csv", BAD)])
    intake = headers.map_headers(cells.limit(0))
    with pytest.raises(ValueError, match=headers.NO_ROWS):
        intake.settle(str(tmp_path / "none"))
