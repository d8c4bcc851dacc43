from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.operators import changes as ch
from ledgerspark.operators import checks as ck
from ledgerspark.operators import dedupe, rules, totals, views
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean, parse_rows
from ledgerspark.sources.tables import source_rows_from_table
from tests import sample


def _lines(df):
    return {r["status"]: (r["rows"], int(r["cents"]), r["unknown_rows"]) for r in df.collect()}


def test_published_sample(spark):
    rows = sample.source_rows(spark)
    records = clean(rows, rules.builtin_rules(spark)).cache()
    assert _lines(totals.reconcile(records)) == {
        "clean": (114, 13171127, 0), "duplicate": (3, 625665, 0),
        "unparseable": (8, 588489, 4), "input": (125, 14385281, 4),
    }
    share = totals.flagged_share(records).first()
    assert (share["flagged"], share["percent"]) == (39, 31.2)
    work = {r["reason_key"]: r["rows"] for r in totals.review_workload(records).collect()}
    assert work == {
        "unmapped": 20, "high": 10, "exactdup": 3, "possibledup": 2, "missingdate": 2,
        "missingamount": 2, "invalidamount": 2, "invaliddate": 1, "ambiguousdate": 1,
    }
    changes = ch.build_changes(records)
    counts = {r["field"]: r["count"] for r in changes.groupBy("field").count().collect()}
    assert counts == {
        "header": 500, "merchant": 92, "category": 125, "amount": 82, "date": 80,
        "disposition": 125,
    }
    assert records.agg(F.sum(ch.change_count())).first()[0] == 1004
    verdicts = ck.check_all(
        [
            ck.check_identity(rows, records), ck.check_partition(records),
            ck.check_amounts(rows, records),
            ck.check_review_complete(reports.report_needs_review(records), records),
            ck.check_changes_complete(changes, records),
        ]
    ).collect()
    assert all(v["ok"] for v in verdicts), verdicts
    formula = records.filter(F.col("merchant") == "=SYNTHETIC_FORMULA_TEXT()")
    assert formula.count() == 1
    # with a limit of CAD 1,000 many more rows need review
    low = clean(rows, rules.builtin_rules(spark, 100_000))
    assert totals.flagged_share(low).first()["flagged"] == 92


def test_summary_of_the_sample(spark):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark))
    out = reports.report_summary(records, S.DEFAULT_HIGH_CENTS, ("2025-01", "2025-12"))
    lines = out.orderBy("section", "place", "label").collect()
    control = [(r["label"], r["cents"], r["rows"]) for r in lines if r["section"] == 0]
    assert [(label, None if c is None else int(c), n) for label, c, n in control] == [
        ("Retained bills", 13171127, 114), ("Exact duplicates excluded", 625665, 3),
        ("Unparseable: known amounts", 588489, 8), ("All known input amounts", 14385281, 125),
        ("Reconciliation difference", 0, None), ("Unknown amounts", None, 4),
        ("Review rows", None, 39),
    ]
    assert len([r for r in lines if r["section"] == 1]) == 12
    assert sum(r["rows"] for r in lines if r["section"] == 2) == 114
    assert [r["note"] for r in lines if r["section"] == 3][0] == "Largest merchant"


def _grouped(records):
    return sorted(
        (r["id"], r["status"], r["duplicate_of"], r["possible_of"])
        for r in records.select("id", "status", "duplicate_of", "possible_of").collect()
    )


def _brute_force(rows):
    """First come, first retained, row by row."""
    exact, near, out = {}, {}, []
    for r in sorted(rows, key=lambda r: r["ord"]):
        key = (r["merchant"], r["bill_date"], r["cents"])
        status, dup, maybe = "clean", None, None
        if r["bill_date"] is None or r["cents"] is None:
            status = "unparseable"
        elif (*key, r["invoice"]) in exact:
            status, dup = "duplicate", exact[(*key, r["invoice"])]
        else:
            exact[(*key, r["invoice"])] = r["id"]
            maybe = near.get(key)
            near.setdefault(key, r["id"])
        out.append((r["id"], status, dup, maybe))
    return sorted(out)


def _skewed_rows(spark):
    """A third of all rows are copies of one bill, another third one bill under many numbers."""
    n = F.col("id")
    df = spark.range(3000).select(
        n.alias("row"),
        F.when(n % 3 == 0, "SAME").otherwise(F.concat(F.lit("I"), (n % 700).cast("string")))
        .alias("inv"),
        F.when(n % 3 < 2, "Demo Supply 01").otherwise(F.concat(F.lit("M"), (n % 40).cast("string")))
        .alias("mer"),
        F.when(n % 17 == 0, "").otherwise("2025-03-01").alias("day"),
        F.when(n % 3 < 2, "10.00").otherwise((n % 9).cast("string")).alias("amt"),
    )
    shuffled = df.repartition(7, F.xxhash64("row"))
    return source_rows_from_table(
        shuffled, {"invoice": "inv", "merchant": "mer", "date": "day", "amount": "amt"}, "row"
    )


def test_duplicates_match_brute_force_under_skew(spark):
    rows = _skewed_rows(spark)
    policy = rules.builtin_rules(spark)
    parsed = rules.categorise(parse_rows(rows), policy)
    expected = _brute_force(parsed.collect())
    assert _grouped(clean(rows, policy, hot=[])) == expected
    hot = dedupe.hot_groups(parsed, 500)
    assert len(hot) == 1, "the frequent bill is found"
    assert _grouped(clean(rows, policy, hot=hot)) == expected
    assert _grouped(clean(rows, policy, hot_rows=1)) == expected


def test_a_frequent_bill_is_spread(spark):
    """No partition gets all rows of the frequent bill."""
    rows = _skewed_rows(spark)
    parsed = rules.categorise(parse_rows(rows), rules.builtin_rules(spark))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        marked = dedupe.mark_duplicates(parsed, dedupe.hot_groups(parsed, 500))
        frequent = marked.filter(F.col("merchant") == "Demo Supply 01")
        sizes = [
            r["n"]
            for r in frequent.select(F.spark_partition_id().alias("p"))
            .groupBy("p").agg(F.count("*").alias("n")).collect()
        ]
    finally:
        spark.conf.unset(name)
    assert sum(sizes) == 2000 and max(sizes) < 600


def test_same_result_for_any_partitioning(spark):
    rows, policy = sample.source_rows(spark), rules.builtin_rules(spark)
    columns = ["id", "status", "reasons", "duplicate_of", "possible_of", "merchant", "cents"]
    first = clean(rows, policy).select(columns)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = clean(rows.repartition(int(n), "invoice_raw"), policy).select(columns)
            assert ck.check_repeatable(first, again).first()["ok"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_shuffle_and_one_sort(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = {f: "o_orderpriority" for f in ("invoice", "merchant", "date", "amount")}
    rows = source_rows_from_table(orders, text, "o_orderkey")
    records = clean(rows, rules.builtin_rules(spark), hot=[])
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "Python" not in plan
    assert "o_totalprice" not in plan, "unused columns are not read"


def test_control_checks_fail_on_damage(spark):
    rows, policy = sample.source_rows(spark), rules.builtin_rules(spark)
    records = clean(rows, policy).cache()
    lost = records.filter(F.col("id") != "1:5")
    assert not ck.check_identity(rows, lost).first()["ok"]
    assert not ck.check_identity(rows, records.unionByName(records.limit(1))).first()["ok"]
    assert not ck.check_amounts(rows, lost).first()["ok"]
    odd = records.withColumn("status", F.when(F.col("id") == "1:5", "lost").otherwise(F.col("status")))
    assert not ck.check_partition(odd).first()["ok"]
    review = reports.report_needs_review(records)
    assert not ck.check_review_complete(review.filter(F.col("id") != "1:10"), records).first()["ok"]
    changes = ch.build_changes(records)
    assert not ck.check_changes_complete(changes.filter("slot <> 6"), records).first()["ok"]
    assert not ck.check_repeatable(records.select("id"), lost.select("id")).first()["ok"]


def test_views_and_pages(spark):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark)).cache()
    kept = totals.bills(records)
    pages = [views.page(kept, [F.col("ord")], n, 50).count() for n in range(4)]
    assert pages == [50, 50, 14, 0]
    assert views.sort_bills(records, "amount", "asc").first()["cents"] is None
    assert views.sort_bills(records, "src", "desc").first()["id"] == "3:45"
    cents = [r["cents"] for r in views.sort_bills(records, "amount", "desc").collect()]
    known = [c for c in cents if c is not None]
    assert cents[: len(known)] == sorted(known, reverse=True)
    undecided = records.withColumn("decided", F.lit(None).cast("string"))
    sizes = [
        abs(-1 if r["cents"] is None else r["cents"])
        for r in views.review_queue(undecided, "amount").collect()
    ]
    assert len(sizes) == 39 and sizes == sorted(sizes, reverse=True)
    assert views.filter_bills(records, q="SYNTHETIC").count() == 1
    assert views.duplicate_pairs(records).filter("original_found").count() == 3
    assert views.possible_duplicate_pairs(records).filter("original_found").count() == 2


def test_generated_code_stays_small_enough_to_be_compiled(spark, sf_dir, capfd):
    """The JVM never compiles methods above 8,000 bytes; parsing would then run interpreted."""
    import re

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = {f: "o_orderpriority" for f in ("invoice", "merchant", "date", "amount")}
    records = clean(
        source_rows_from_table(orders, text, "o_orderkey"), rules.builtin_rules(spark), hot=[]
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        records.explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capfd.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_equal_high_bills_keep_their_source_order(spark):
    rows = sample.source_rows(spark)
    records = clean(rows, rules.builtin_rules(spark))
    same = records.withColumn("cents", F.lit(900_000).cast(records.schema["cents"].dataType))
    out = reports.report_summary(same, S.DEFAULT_HIGH_CENTS)
    lines = out.filter("section = 4").orderBy(*reports.SUMMARY_ORDER).collect()
    kept = totals.bills(same).orderBy("ord").collect()
    assert [r["label"] for r in lines] == [r["invoice"] for r in kept]
