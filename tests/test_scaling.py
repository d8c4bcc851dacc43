"""Tables are compared by digests, and numbered entries come out in their order."""

from ledgerspark.operators import changes as ch
from ledgerspark.operators import checks as ck
from ledgerspark.operators import rules
from ledgerspark.plans.clean import clean
from ledgerspark.sinks import ledger
from ledgerspark.sources.tables import source_rows_from_table

COLUMNS = "id string, note string, n bigint, list array<string>"


def table(spark, changed=()):
    rows = {k: (f"i{k}", None if k % 3 else f"n{k}", k, [None, f"{k}"]) for k in range(500)}
    rows.update(changed)
    return spark.createDataFrame(list(rows.values()), COLUMNS)


def verdict(a, b):
    return tuple(ck.check_same(a, b, "same").first())


def test_equal_tables_are_told_by_digests(spark):
    a, b = table(spark), table(spark).repartition(5)
    assert ck.differing_buckets(a, b) == []
    assert verdict(a, b) == ("same", True, "0 differing rows")


def test_differing_rows_are_counted_exactly(spark):
    a = table(spark)
    # a null that trades places, a list cut in another way, a copy too many
    b = table(spark, {1: ("i1", "1", None, [None, "1"]), 2: ("i2", None, 2, ["2", None])})
    assert 0 < len(ck.differing_buckets(a, b)) <= 4
    assert verdict(a, b) == ("same", False, "4 differing rows")
    assert verdict(a, a.unionByName(a.filter("n = 7"))) == ("same", False, "1 differing rows")
    assert verdict(a.filter("n < 0"), a.filter("n < 0")) == ("same", True, "0 differing rows")


def records(spark, rows=400):
    place = [(k * 997, f" inv{k} ", "Acme", "2024-01-02", f"${k}.00") for k in range(rows)]
    df = spark.createDataFrame(place[::-1], "o bigint, invoice string, merchant string, date string, amount string")
    source = source_rows_from_table(df, {f: f for f in ("invoice", "merchant", "date", "amount")}, row_order="o")
    return clean(source, rules.builtin_rules(spark)).repartition(7, "id")


def test_numbered_entries_come_in_order(spark, tmp_path, monkeypatch):
    r = records(spark)
    total = ch.build_changes(r).count()
    # 400 rows lie in seven blocks
    assert [x.n for x in ch.numbered_build_changes(r).collect()] == list(range(1, total + 1))
    monkeypatch.setattr(ch, "fits_broadcast", lambda df: False)
    assert [x.n for x in ch.numbered_build_changes(r).collect()] == list(range(1, total + 1))


def test_log_files_are_in_order(spark, tmp_path):
    r = records(spark, 50)
    ledger.write_change_log_csv(str(tmp_path / "log"), r)
    lines = [s for f in sorted((tmp_path / "log").glob("*.csv")) for s in f.read_text().splitlines()[1:]]
    assert [int(s.split(",")[0].strip('"')) for s in lines] == list(range(1, len(lines) + 1))
