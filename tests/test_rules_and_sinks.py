import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.operators import changes as ch
from ledgerspark.operators import checks as ck
from ledgerspark.operators import review, rules, skew, totals
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean
from ledgerspark.sinks import ledger as sinks
from ledgerspark.sources import documents, exports, headers
from tests import sample
from tests.test_intake import PLAIN, write_csv

DOCUMENT = {
    "aliases": [
        {"alias": "Harbour Lights", "category": "Utilities"},
        {"alias": "  demo-software 03", "category": "Transport"},
    ],
    "high_cad": 99.95,
}


def policy_file(tmp_path, value):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(value))
    return str(path)


def test_reviewer_rules_come_before_builtin_ones(spark, tmp_path):
    given = documents.load_rules(spark, policy_file(tmp_path, DOCUMENT))
    assert given.high_cents == 9995
    spellings = ["HARBOUR LIGHTS", "harbour--lights", "Harbour Light", " Demo Software 03 "]
    bills = [[f"n{i}", name, "2026-05-04", f"{99 + i}.95"] for i, name in enumerate(spellings)]
    path = write_csv(tmp_path / "bills.csv", [PLAIN, *bills])
    cells = exports.read_exports(spark, [path])
    in_force = rules.effective_rules(rules.builtin_rules(spark), given)
    records = clean(headers.map_headers(cells).or_fail(), in_force).cache()
    rows = {r["invoice_raw"]: r for r in records.collect()}
    assert [rows[f"n{i}"]["category"] for i in range(4)] == ["Utilities", "Utilities", S.UNCATEGORISED, "Transport"]
    assert {rows["n0"]["merchant"], rows["n1"]["merchant"]} == {"Harbour Lights"}
    assert all(any("99.95" in x for x in rows[f"n{i}"]["reasons"]) for i in range(4))
    by_rule = ch.build_changes(records).filter("field = 'category'").groupBy("rule", "who").count().collect()
    assert {(r["rule"], r["who"]): r["count"] for r in by_rule} == {
        ("reviewer alias rule", "you"): 3, ("no rule; manual review", "build"): 1,
    }


def policy(high=1, *aliases, **more):
    return {"aliases": [{"alias": a, "category": c} for a, c in aliases], "high_cad": high, **more}


@pytest.mark.parametrize(
    "value",
    [
        # the document
        "rules", None, 7, [policy()], {}, {"high_cad": 1}, policy(note=""),
        # the limit: a number of CAD with whole cents, not below zero
        policy("12"), policy(None), policy([1]), policy(False), policy(-0.01), policy(0.005), policy(1e400),
        # the list and its entries
        {"aliases": None, "high_cad": 1}, {"aliases": "Elm", "high_cad": 1}, {"aliases": ["Elm"], "high_cad": 1},
        {"aliases": [{"alias": "Elm"}], "high_cad": 1}, {"aliases": [{"alias": 5, "category": "Rent"}], "high_cad": 1},
        # names: letters or digits of ASCII, one category of the list each
        policy(1, ("", "Rent")), policy(1, ("日本", "Rent")), policy(1, ("Elm", "rent")), policy(1, ("Elm", None)),
        policy(1, ("Elm 1", "Rent"), ("elm-1", "Transport")),
    ],
)
def test_documents_that_break_the_rule_contract(spark, tmp_path, value):
    with pytest.raises(ValueError):
        documents.load_rules(spark, policy_file(tmp_path, value))


def test_limit_must_agree_and_lenient_mode(spark, tmp_path):
    path = policy_file(tmp_path, {"aliases": [], "high_cad": 10})
    with pytest.raises(ValueError, match="conflicts"):
        documents.load_rules(spark, path, high_cents=2000)
    loose = policy_file(
        tmp_path,
        {"aliases": [{"alias": "A", "category": "Rent"}, {"alias": "B", "category": "Pets"}, {}]},
    )
    got = documents.load_rules(spark, loose, mode="lenient")
    assert [r["alias"] for r in got.df.collect()] == ["A"]
    assert got.high_cents == S.DEFAULT_HIGH_CENTS


def test_rules_round_trip(spark, tmp_path):
    given = documents.load_rules(spark, policy_file(tmp_path, DOCUMENT))
    out = str(tmp_path / "exported")
    sinks.write_rules(out, given)
    again = documents.load_rules(spark, out)
    assert ck.check_policy(again, given).first()["ok"]
    other = rules.Rules(given.df.limit(1), given.high_cents)
    assert not ck.check_policy(other, given).first()["ok"]
    assert not ck.check_policy(rules.Rules(given.df, 1100), given).first()["ok"]


def test_ledger_tables(spark, tmp_path):
    policy = rules.builtin_rules(spark)
    records = clean(sample.source_rows(spark), policy).cache()
    changes = ch.build_changes(records)
    decisions = review.decisions_from_bulk(records.limit(2), "confirm", 1, dt.datetime(2026, 1, 1))
    out = str(tmp_path / "ledger")
    sinks.write_ledger(out, records, changes, policy, [str(tmp_path / "in.csv")], decisions)
    back = spark.read.parquet(f"{out}/records")
    assert ck.check_repeatable(records, back.select(records.columns)).first()["ok"]
    assert ck.check_changes_complete(spark.read.parquet(f"{out}/changes"), back).first()["ok"]
    lines = spark.read.parquet(f"{out}/reconciliation").collect()
    assert {r["status"] for r in lines} == {"clean", "duplicate", "unparseable", "input"}
    assert ck.check_policy(sinks.read_ledger_policy(spark, out), policy).first()["ok"]
    assert documents.load_decisions(spark, f"{out}/decisions").count() == 2
    with pytest.raises(Exception):  # an existing ledger is never replaced
        sinks.write_ledger(out, records, changes, policy, [])


@pytest.mark.parametrize("out", ["/data/in", "/data/in/x.csv", "/data", "file:///data/in/x.csv/y"])
def test_output_must_not_overlap_inputs(out):
    with pytest.raises(ValueError, match="overlap"):
        sinks.check_no_overlap(out, ["/data/in/x.csv"])


def test_output_next_to_inputs_is_fine():
    sinks.check_no_overlap("/data/out", ["/data/in/x.csv", "file:/data/outer"])


def test_reports_and_change_log_csv(spark, tmp_path):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark)).cache()
    changes = ch.build_changes(records)
    made = review.reviewer_changes(
        records, review.decisions_from_bulk(records.limit(3), "confirm", 1, dt.datetime(2026, 1, 1))
    )
    out = str(tmp_path / "reports")
    sinks.write_reports(
        out,
        {
            "bills": reports.report_bills(records),
            "needs_review": reports.report_needs_review(records),
            "duplicates": reports.report_duplicates(records),
            "change_log": reports.report_change_log(ch.change_log(changes, made)),
            "summary": reports.report_summary(records, S.DEFAULT_HIGH_CENTS),
        },
    )
    sizes = {
        n: spark.read.parquet(f"{out}/{n}").count()
        for n in ("bills", "needs_review", "duplicates", "change_log")
    }
    assert sizes == {"bills": 114, "needs_review": 39, "duplicates": 3, "change_log": 1007}
    one_month = spark.read.parquet(f"{out}/bills").filter("month = '2025-03'")
    assert one_month.count() == totals.monthly_totals(totals.bills(records)).filter(
        "month = '2025-03'"
    ).first()["rows"]

    path = str(tmp_path / "log")
    sinks.write_change_log_csv(path, records, made)
    text = "".join(open(f).read() for f in sorted(map(str, (tmp_path / "log").glob("part-*"))))
    body = [line for line in text.splitlines() if not line.startswith('"n"')]
    assert len(body) == 1007
    assert body[0] == (
        '"1","1:5","header","Invoice","invoice","header alias map","build",""'
    )
    assert body[-1].startswith('"1007","') and body[-1].endswith('"you","2026-01-01T00:00:00Z"')
    assert [int(line.split('"')[1]) for line in body] == list(range(1, 1008))


def test_salted_join_equals_plain_join(spark):
    left = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.col("id") % 97).alias("k"), "id",
    )
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", "left").select("id", "k", "v")
    assert skew.heavy_keys(left, F.xxhash64("k"), 1000), "the frequent key is found"
    salted = skew.salted_join(left, right, ["k"], "id", hot_rows=1000).select("id", "k", "v")
    assert ck.check_repeatable(plain, salted).first()["ok"]
    assert skew.heavy_keys(left.limit(0), F.xxhash64("k"), 1) == []
    assert len(skew.heavy_keys(spark.range(50_000), F.xxhash64("id"), 1)) <= skew.TOP_KEYS


@pytest.mark.parametrize("block", [7, 65_536])
def test_numbers_of_the_change_log_follow_source_order(spark, monkeypatch, block):
    monkeypatch.setattr(ch, "BLOCK_ROWS", block)
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark)).cache()
    got = [r[1:] for r in sorted(ch.numbered_build_changes(records).select("n", "id", "field", "before", "after", "rule", "who").collect())]
    log = ch.build_changes(records).orderBy("ord", "slot").select("id", "field", "before", "after", "rule", "who").collect()
    assert got == [tuple(r) for r in log] and len(got) == 1004
    numbers = [r.n for r in ch.numbered_build_changes(records).collect()]
    assert sorted(numbers) == list(range(1, 1005))
    assert ch.numbered_build_changes(records.limit(0)).count() == 0


def files_in_order(spark, path):
    """The rows of each file of a table, files by name."""
    files = sorted(spark.read.parquet(path).inputFiles())
    return [spark.read.parquet(f).select("ord", "slot", "seq", "id", "field").collect() for f in files]


def test_tables_that_are_laid_out_are_made_once_and_keep_their_order(spark, tmp_path):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark)).cache()
    entries = ch.build_changes(records).count()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    counting = counted.asNondeterministic()
    made = review.reviewer_changes(
        records, review.decisions_from_bulk(records.limit(3), "confirm", 1, dt.datetime(2026, 1, 1))
    )
    build = ch.build_changes(sinks.in_order(records)).withColumn("field", counting("field"))
    log = ch.change_log(build, sinks.in_order(made))
    out = str(tmp_path / "reports")
    by_month = reports.report_bills(sinks.in_month_order(records))
    sinks.write_reports(out, {"change_log": reports.report_change_log(log), "bills": by_month}, laid_out=["change_log", "bills"])
    assert seen.value == entries, "the entries are not made again to find ranges"
    parts = files_in_order(spark, f"{out}/change_log")
    for reviewed in (False, True):
        run = [(r.ord, r.slot, r.seq or 0) for part in parts for r in part if (r.slot == ch.REVIEW_SLOT) == reviewed]
        assert run == sorted(run) and len(run) == (3 if reviewed else entries)
    assert spark.read.parquet(f"{out}/bills").count() == totals.bills(records).count()
    for file in spark.read.parquet(f"{out}/bills").inputFiles():
        places = [r.ord for r in spark.read.parquet(file).select("ord").collect()]
        assert places == sorted(places)

    seen.value = 0
    build = ch.build_changes(sinks.in_order(records)).withColumn("field", counting("field"))
    sinks.write_ledger(str(tmp_path / "ledger"), records, build, rules.builtin_rules(spark), [], laid_out=True)
    assert seen.value == entries
    stored = [r for part in files_in_order(spark, str(tmp_path / "ledger" / "changes")) for r in part]
    wanted = ch.build_changes(records).orderBy("ord", "slot").select("ord", "slot", "seq", "id", "field").collect()
    assert stored == wanted


def test_rules_of_decisions_are_written_once(spark, tmp_path):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark)).cache()
    decided = review.decisions_from_bulk(
        records.limit(5), "category", 1, dt.datetime(2026, 1, 1), after="Rent", rule_added=F.concat(F.lit("rule-"), "id")
    )
    folder = str(tmp_path / "rules")
    plain = review.rules_from_decisions(records, decided)
    stored = review.rules_from_decisions(records, decided, folder=folder)
    assert stored.df.inputFiles() and all(folder in f for f in stored.df.inputFiles())
    assert ck.check_policy(stored, plain).first()["ok"] and stored.df.count() == plain.df.count() > 0
    # records hold their source rows: cleaning these again gives what cleaning the input gives
    again = clean(records.select(S.SOURCE_ROW_COLUMNS), rules.effective_rules(rules.builtin_rules(spark), stored))
    wanted = clean(sample.source_rows(spark), rules.effective_rules(rules.builtin_rules(spark), plain))
    assert ck.check_repeatable(again, wanted).first()["ok"]
