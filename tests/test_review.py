import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.operators import changes as ch
from ledgerspark.operators import checks as ck
from ledgerspark.operators import review, rules, totals, views
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean
from ledgerspark.sources import documents
from ledgerspark.testing.catalog import all_queries
from ledgerspark.testing.oracles import all_oracles
from tests import sample

AT = dt.datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def base(spark):
    out = clean(sample.source_rows(spark), rules.builtin_rules(spark), hot=[]).cache()
    yield out
    out.unpersist()


def log(spark, *entries):
    """Entries ``(row, action, after)`` or ``(row, 'undo', seq of the undone entry)``."""
    rows = []
    for seq, (row, action, after) in enumerate(entries, 1):
        undone = f"d{after}" if action == "undo" else None
        rows.append(
            (seq, f"d{seq}", row, action, None if undone else after, None, None, undone, AT)
        )
    return spark.createDataFrame(rows, S.DECISIONS)


OPEN, KEPT = "1:10", "1:6"  # an unmapped row without a date, and a clean row
DATE, EDITED, OUT = [S.R_MISSING_DATE], [S.R_EDITED], [S.R_EXCLUDED]


def marked(row):
    return f"marked duplicate of {row} by reviewer"


# decisions; the final (category, status, duplicate_of, reasons, decided) of the rows that differ
# from the start; the entries (row, field, before, after) of the change log
REPLAYS = {
    "a category takes the flag away": (
        [(OPEN, "category", "Software")],
        {OPEN: ("Software", "unparseable", None, DATE, None)},
        [(OPEN, "category", S.UNCATEGORISED, "Software")],
    ),
    "a confirmation is kept": (
        [(OPEN, "category", "Software"), (OPEN, "confirm", None)],
        {OPEN: ("Software", "unparseable", None, DATE, "confirm")},
        [(OPEN, "category", S.UNCATEGORISED, "Software"), (OPEN, "review", "flagged", "confirmed as is")],
    ),
    "an undone confirmation is not": (
        [(OPEN, "category", "Software"), (OPEN, "confirm", None), (OPEN, "undo", 2)],
        {OPEN: ("Software", "unparseable", None, DATE, None)},
        [(OPEN, "category", S.UNCATEGORISED, "Software"), (OPEN, "decision", "confirm", "undone")],
    ),
    "an edited clean row is listed": (
        [(KEPT, "category", "Rent")],
        {KEPT: ("Rent", "clean", None, EDITED, None)},
        [(KEPT, "category", "Utilities", "Rent")],
    ),
    "there and back": (
        [(KEPT, "category", S.UNCATEGORISED), (KEPT, "category", "Rent")],
        {KEPT: ("Rent", "clean", None, EDITED, None)},
        [(KEPT, "category", "Utilities", S.UNCATEGORISED), (KEPT, "category", S.UNCATEGORISED, "Rent")],
    ),
    "excluded between two categories": (
        [(KEPT, "category", S.UNCATEGORISED), (KEPT, "exclude", None), (KEPT, "category", "Rent")],
        {KEPT: ("Rent", "excluded", None, OUT, None)},
        [(KEPT, "category", "Utilities", S.UNCATEGORISED), (KEPT, "disposition", "clean", "excluded"),
         (KEPT, "category", S.UNCATEGORISED, "Rent")],
    ),
    "a duplicate that is excluded": (
        [(KEPT, "duplicate", "1:5"), (KEPT, "category", "Rent"), (KEPT, "exclude", None)],
        {KEPT: ("Rent", "excluded", "1:5", [marked("1:5"), *OUT], "exclude")},
        [(KEPT, "disposition", "clean", "duplicate"), (KEPT, "category", "Utilities", "Rent"),
         (KEPT, "disposition", "duplicate", "excluded")],
    ),
    "the last duplicate counts": (
        [(KEPT, "exclude", None), (KEPT, "duplicate", "1:7"), (KEPT, "duplicate", "1:8")],
        {KEPT: ("Utilities", "duplicate", "1:8", [*OUT, marked("1:7"), marked("1:8")], "duplicate")},
        [(KEPT, "disposition", "clean", "excluded"), (KEPT, "disposition", "excluded", "duplicate"),
         (KEPT, "disposition", "duplicate", "duplicate")],
    ),
    "an unknown row": (
        [("9:9", "confirm", None), ("9:9", "confirm", None), ("9:9", "undo", 2)],
        {},
        [("9:9", "decision", "confirm", "undone")],
    ),
    "an undone category": (
        [(OPEN, "category", "Rent"), (OPEN, "undo", 1), (OPEN, "category", "Software")],
        {OPEN: ("Software", "unparseable", None, DATE, None)},
        [(OPEN, "decision", "category", "undone"), (OPEN, "category", S.UNCATEGORISED, "Software")],
    ),
    "the same twice, and another row": (
        [(OPEN, "category", "Rent"), (OPEN, "category", "Rent"), ("1:11", "confirm", None)],
        {OPEN: ("Rent", "unparseable", None, DATE, None), "1:11": ("Supplies", "clean", None, [], "confirm")},
        [(OPEN, "category", S.UNCATEGORISED, "Rent"), (OPEN, "category", "Rent", "Rent"),
         ("1:11", "review", "flagged", "confirmed as is")],
    ),
}


@pytest.mark.parametrize("name", REPLAYS)
def test_replay(spark, base, name, monkeypatch):
    case, final, entries = REPLAYS[name]
    decisions = log(spark, *case)
    fields = ["category", "status", "duplicate_of", "reasons"]
    want = {r["id"]: (*(r[f] for f in fields), None) for r in base.collect()} | final
    got = review.apply_decisions(base, decisions).collect()
    assert {r["id"]: tuple(r[f] for f in [*fields, "decided"]) for r in got} == want
    # blocks of two decisions, so that values must be carried from block to block
    monkeypatch.setattr(review, "CARRY_BLOCK", 2)
    made = review.reviewer_changes(base, decisions).orderBy("seq").collect()
    assert [(m["id"], m["field"], m["before"], m["after"]) for m in made] == entries


def test_excluded_rows_stay_in_the_control_total(spark, base):
    done = review.apply_decisions(base, log(spark, ("1:6", "exclude", None)))
    lines = {r["status"]: (r["rows"], int(r["cents"])) for r in totals.reconcile(done, True).collect()}
    assert lines["excluded"][0] == 1 and lines["input"] == (125, 14385281)
    assert sum(v[1] for k, v in lines.items() if k != "input") == 14385281
    summary = reports.report_summary(done, S.DEFAULT_HIGH_CENTS).filter("section = 0")
    by_label = {r["label"]: r["cents"] for r in summary.collect()}
    assert by_label["Excluded by reviewer"] == lines["excluded"][1]
    assert by_label["Reconciliation difference"] == 0


def test_confirming_an_unreadable_row_keeps_it_unreadable(spark, base):
    done = review.apply_decisions(base, log(spark, ("1:10", "confirm", None)))
    row = done.filter(F.col("id") == "1:10").first()
    assert (row["decided"], row["status"], row["date_raw"]) == ("confirm", "unparseable", "")
    counts = review.review_counts(done).first()
    assert (counts["pending"], counts["reviewed"]) == (38, 1)
    queue = views.review_queue(done)
    assert views.filter_queue(queue, "decided").count() == 1
    assert queue.collect()[-1]["id"] == "1:10"


def test_undo_and_rules(spark, base):
    d = log(spark, ("1:10", "category", "Software"), ("1:11", "confirm", None))
    d = d.withColumn("rule_added", F.when(F.col("seq") == 1, "r1"))
    policy = rules.rules_from_pairs(spark, [("Acme", "Rent", "r1"), ("Beta", "Rent", "r2")], "reviewer")
    after = d.unionByName(review.undo(d, ["d1"], 3, AT))
    assert {r["id"] for r in review.active_decisions(after).collect()} == {"d2", "undo-d1"}
    assert [r["alias"] for r in review.rules_in_force(policy, after).df.collect()] == ["Beta"]
    assert review.undo(after, ["d1"], 4, AT).count() == 0
    assert review.latest_decision(after).first()["row_id"] == "1:11"


def test_bulk_decisions(spark, base):
    picked = views.filter_bills(base, reason="unmapped")
    d = review.decisions_from_bulk(picked, "category", 10, AT, after="Supplies").orderBy("seq")
    rows = d.collect()
    assert [r["seq"] for r in rows] == list(range(10, 10 + picked.count()))
    assert [r["row_id"] for r in rows] == [r["id"] for r in picked.orderBy("ord").collect()]
    done = review.apply_decisions(base, d)
    assert views.filter_bills(done, reason="unmapped").count() == 0
    made = review.reviewer_changes(base, d)
    everything = ch.change_log(ch.build_changes(base), made)
    assert ck.check_reviewer_changes(everything, d).first()["ok"]
    assert not ck.check_reviewer_changes(everything.filter("seq <> 10"), d).first()["ok"]


def test_preview(spark, base):
    rows = sample.source_rows(spark)
    old = rules.builtin_rules(spark)
    reviewer = rules.rules_from_pairs(spark, [("DEMO OTHER 06", "Rent")], "reviewer", 100_000)
    new = rules.effective_rules(old, reviewer)
    then = clean(rows, new, hot=[])
    p = review.preview_rules(base, old, new).first()
    expected = base.alias("a").join(then.alias("b"), "id").filter("a.category <> b.category").count()
    assert p["recategorised"] == expected > 0
    assert (p["flagged_now"], p["changes_now"]) == (39, 1004)
    assert p["flagged_then"] == then.filter("size(reasons) > 0").count()
    assert p["changes_then"] == ch.build_changes(then).count()


def _by_cleaning_twice(now, then, decisions):
    """The preview's figures from two whole sets of records."""
    done = [r if decisions is None else review.apply_decisions(r, decisions) for r in (now, then)]
    flagged = [r.filter("size(reasons) > 0").count() for r in done]
    both = now.alias("a").join(then.alias("b"), "id").filter("a.category <> b.category").select("id")
    if decisions is not None:
        kept = review.active_decisions(decisions).filter("action = 'category'").select(F.col("row_id").alias("id"))
        both = both.join(kept, "id", "left_anti")
    log = [ch.build_changes(r).count() for r in (now, then)]
    return (both.count(), *flagged, *log)


@pytest.mark.parametrize(("decided", "hot"), [(False, 2), (True, None)])
def test_preview_equals_cleaning_twice(spark, sf_dir, decided, hot, monkeypatch):
    from ledgerspark.operators import dedupe, skew
    from ledgerspark.testing import fixtures as fx
    from ledgerspark.testing.dirty_bills import SEGMENT_CATEGORY, dirty_bills, dirty_rules

    if hot:  # no lookup is broadcast, and every group of two rows counts as frequent
        monkeypatch.setattr(review, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        monkeypatch.setattr(dedupe, "HOT_ROWS", hot)
    rows, old = dirty_bills(spark, sf_dir).cache(), dirty_rules(spark)
    seg = [s for s, _ in SEGMENT_CATEGORY]
    # two vendors become one, one gets another category only, one loses its rule, limit as given
    pairs = [(f"{seg[0]} vendor 31", "Rent", "r1"), (f"{seg[0]} vendor 5", "Travel", "r2"), (f"{seg[1]} VENDOR 7", "Rent", "r3")]
    merged = rules.rules_from_pairs(spark, pairs, "reviewer").df
    # the key of vendor 6 gets the name of vendor 5
    alias = F.when(F.col("alias") == f"{seg[0]} vendor 6", f"{seg[0]} vendor 5").otherwise(F.col("alias"))
    kept = old.df.join(merged.select("norm_key"), "norm_key", "left_anti").filter(F.col("alias") != f"{seg[2]} vendor 2")
    df = merged.unionByName(kept.withColumn("alias", alias)).cache()
    decisions = fx.decision_log(spark, sf_dir).cache() if decided else None
    now = clean(rows, old, hot=[]).cache()
    for limit in (old.high_cents // 2, old.high_cents * 2)[: 1 if hot else 2]:
        new = rules.Rules(df, limit, None if hot else 1000)
        got = review.preview_rules(now, old, new, decisions).first()
        assert tuple(got) == _by_cleaning_twice(now, clean(rows, new, hot=[]).cache(), decisions)


@pytest.mark.parametrize("name", ["report_summary_reviewed", "check_reviewer_changes"])
def test_reviewed_queries_cover_all_rows(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(all_oracles()[name])
    got = all_queries()[name](spark, sf_dir)
    want = want.select(*got.columns).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    if name == "report_summary_reviewed":
        assert {r[0] for r in want} == {0, 1, 2, 3, 4}
    else:
        # decisions on rows that the input does not have are part of the check
        assert want[0][1] is False


def test_damaged_decision_log(spark, tmp_path):
    whole = '{"seq":%d,"id":"%s","row_id":"1:1:2","action":"confirm"}'
    lines = [
        whole % (1, "a"), whole % (2, "b"), whole % (2, "b"), whole % (2, "b"), "", "  ", "null", "[1", "7",
        whole % (5, "e"), whole % (5, "f"), '{"seq":6,"id":"g","action":"confirm"}',
        '{"seq":8,"id":"h","row_id":"1:1:2","action":"approve"}', '{"seq":9,"id":"i","action":"undo","undo_of":"a"}',
        '{"seq":"x","id":"j","row_id":"1:1:2","action":"confirm"}', whole % (12, "k"),
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(lines) + "\n" + whole % (13, "l"))
    log = documents.read_decisions(spark, str(path))
    assert sorted(r["seq"] for r in log.rows.collect()) == [1, 2, 9, 12, 13]
    got = {(r["line"], r["copies"], r["reason"]) for r in log.rejects.collect()}
    assert got == {
        (whole % (2, "b"), 2, documents.REPEATED_LINE),
        ("null", 1, documents.BROKEN_LINE), ("[1", 1, documents.BROKEN_LINE), ("7", 1, documents.BROKEN_LINE),
        (whole % (5, "e"), 1, documents.REUSED_NUMBER), (whole % (5, "f"), 1, documents.REUSED_NUMBER),
        (lines[11], 1, documents.INCOMPLETE), (lines[12], 1, documents.UNKNOWN_ACTION),
        (lines[14], 1, documents.BROKEN_LINE),
    }
    gaps = documents.decision_gaps(log.rows).collect()
    assert sorted(map(tuple, gaps)) == [(3, 8), (10, 11)]
    assert documents.decision_gaps(log.rows.limit(0)).count() == 0
    path.write_text("")
    empty = documents.read_decisions(spark, str(path))
    assert empty.rows.count() == 0 and empty.rejects.count() == 0
