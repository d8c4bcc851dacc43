"""Self-checks.  Each returns one row ``(check, ok, detail)``.

Comparisons tag both sides, union them and count per key, which takes one shuffle and works
whatever the number of repeats of a key.  Whole tables are compared by digests of buckets of rows
first, and only rows of buckets that differ are shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import amount_cents, cents_sum, norm_key
from ledgerspark.operators.changes import build_changes
from ledgerspark.operators.review import active_decisions
from ledgerspark.operators.rules import Rules, check_rule_snapshot
from ledgerspark.operators.suggest import suggestions_report

# buckets of rows by which tables are compared
BUCKETS = 1024
_LOW = (1 << 32) - 1


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _verdict(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"),
        detail.alias("detail"),
    )


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def ledger_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two tables do not share, with ``only_in`` (a or b) and ``copies``."""
    columns = a.columns
    sides = a.select(*columns, F.lit(1).alias("_w")).unionByName(
        b.select(*columns, F.lit(-1).alias("_w"))
    )
    return (
        sides.groupBy(columns).agg(F.sum("_w").alias("_d")).filter(F.col("_d") != 0)
        .select(
            *columns,
            F.when(F.col("_d") > 0, "a").otherwise("b").alias("only_in"),
            F.abs("_d").alias("copies"),
        )
    )


def _hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row; nulls and nested values are told apart from others."""
    nested = ("struct", "array", "map")
    values = [
        F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if f.dataType.typeName() in nested else F.col(f.name)
        for f in df.schema.fields
    ]
    nulls = [F.col(f.name).isNull() for f in df.schema.fields]
    return F.xxhash64(*values, *nulls), F.xxhash64(F.lit(1), *nulls, *reversed(values))


def differing_buckets(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets of rows in which the tables differ, at most ``BUCKETS`` of them; one small job.

    Rows fall into buckets by their hash, so equal rows share one.  A bucket's digest is its number
    of rows and the sums of two hashes, which is a map-side combined aggregate.
    """
    def side(df: DataFrame, weight: int) -> DataFrame:
        one, two = _hashes(df)
        return df.select(one.alias("_one"), two.alias("_two"), F.lit(weight).cast("bigint").alias("_w"))

    # halves, whose sums fit a bigint for two billion rows of a bucket
    halves = [
        half * F.col("_w") for h in ("_one", "_two")
        for half in (F.shiftright(h, 32), F.col(h).bitwiseAND(F.lit(_LOW)))
    ]
    sums = [F.sum(c).alias(f"_s{i}") for i, c in enumerate([F.col("_w"), *halves])]
    sides = side(a, 1).unionByName(side(b.select(a.columns), -1))
    bucket = F.pmod("_one", F.lit(BUCKETS)).alias("_bucket")
    differ = reduce(Column.__or__, [F.col(f"_s{i}") != 0 for i in range(len(sums))])
    return sorted(r[0] for r in sides.groupBy(bucket).agg(*sums).filter(differ).select("_bucket").collect())


def check_same(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Two tables have the same rows, as often.

    Both are read for digests, which move no rows; rows are moved and compared exactly where the
    digests of a bucket differ, and then both tables are read once more.  Only a change that keeps
    the number of rows and both sums of 64-bit hashes of a bucket would go unnoticed.
    """
    wanted = differing_buckets(a, b)

    def rows(df: DataFrame) -> DataFrame:
        return df.filter(F.pmod(_hashes(df)[0], F.lit(BUCKETS)).isin(wanted))

    return count_verdict(ledger_diff(rows(a), rows(b.select(a.columns))), name)


def count_verdict(diff: DataFrame, name: str) -> DataFrame:
    """The verdict on the rows that two tables do not share."""
    differing = diff.agg(_sum("copies").alias("n"))
    return _verdict(differing, name, F.col("n") == 0, _text(F.col("n"), " differing rows"))


def check_identity(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Every source row appears exactly once among the records."""
    tagged = rows.select("id", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(
        records.select("id", F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    per_id = tagged.groupBy("id").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    bad = (F.col("s") != 1) | (F.col("r") != 1)
    totals = per_id.agg(
        _sum("s").alias("source"), _sum("r").alias("records"), F.count_if(bad).alias("bad")
    )
    return _verdict(
        totals, "identity", F.col("bad") == 0,
        _text(F.col("records"), " records for ", F.col("source"), " source rows"),
    )


def check_partition(records: DataFrame) -> DataFrame:
    """Every record has one of the known statuses."""
    known = F.coalesce(F.col("status").isin(S.STATUSES_WITH_REVIEW), F.lit(False))
    totals = records.agg(F.count("*").alias("n"), F.count_if(known).alias("known"))
    return _verdict(
        totals, "partition", F.col("n") == F.col("known"),
        _text(F.col("known"), " of ", F.col("n"), " rows in a known group"),
    )


def check_amounts(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Cents of all groups equal the control total read again from the source text."""
    known = F.col("status").isin(S.STATUSES_WITH_REVIEW)
    by_group = records.agg(_zero_sum(F.when(known, F.col("cents"))).alias("cents"))
    control = rows.select(amount_cents("amount_raw").alias("cents")).agg(_zero_sum("cents"))
    totals = by_group.withColumn("control", control.scalar())
    return _verdict(
        totals, "amounts", F.col("cents") == F.col("control"),
        _text(F.col("cents"), " cents in groups, ", F.col("control"), " cents read"),
    )


def _zero_sum(c) -> Column:
    return F.coalesce(cents_sum(c), F.lit(0))


def check_review_complete(review: DataFrame, records: DataFrame) -> DataFrame:
    """The review table lists exactly the flagged rows."""
    tagged = review.select("id", F.lit(1).alias("d")).unionByName(
        records.filter(F.size("reasons") > 0).select("id", F.lit(-1).alias("d"))
    )
    per_id = tagged.groupBy("id").agg(F.sum("d").alias("d"), F.count_if(F.col("d") > 0).alias("n"))
    totals = per_id.agg(F.count_if(F.col("d") != 0).alias("bad"), _sum("n").alias("n"))
    return _verdict(
        totals, "review", F.col("bad") == 0, _text(F.col("n"), " rows listed for review")
    )


def check_changes_complete(changes: DataFrame, records: DataFrame) -> DataFrame:
    """The stored automatic entries equal a recomputation from the records."""
    columns = ["id", "slot", "field", "before", "after", "rule"]
    build = changes.filter(F.col("seq").isNull()).select(columns)
    return check_same(build, build_changes(records).select(columns), "changes")


def check_reviewer_changes(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """There is one reviewer entry per decision in force."""
    entries = changes.filter(F.col("seq").isNotNull()).select("seq", F.lit(1).alias("d"))
    wanted = active_decisions(decisions).select("seq", F.lit(-1).alias("d"))
    per_seq = entries.unionByName(wanted).groupBy("seq").agg(F.sum("d").alias("d"))
    totals = per_seq.agg(F.count_if(F.col("d") != 0).alias("bad"), F.count("*").alias("n"))
    return _verdict(
        totals, "reviewer changes", F.col("bad") == 0, _text(F.col("n"), " review changes")
    )


def check_policy(given: Rules, stored: Rules) -> DataFrame:
    """The recorded limit and rules match the supplied policy."""
    cmp = check_rule_snapshot(given, stored)
    return _verdict(
        cmp, "policy", F.col("ok"),
        _text(F.col("missing"), " rules missing, ", F.col("unexpected"), " unexpected"),
    )


def check_repeatable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs gave the same rows."""
    return check_same(first, second, "repeatable")


def check_advisory(report: DataFrame, cache: DataFrame, records: DataFrame) -> DataFrame:
    """The report is the one that the cache gives, and no suggested merchant was categorised."""
    given = suggestions_report(records, cache)
    wrong = ledger_diff(report.select(given.columns), given).agg(_sum("copies").alias("n"))
    applied = (
        records.filter(F.col("category") != S.UNCATEGORISED).select("merchant").distinct()
        .join(report.select("merchant"), "merchant", "left_semi")
        .agg(F.count("*").alias("n"))
    )
    totals = wrong.select(F.col("n").alias("wrong"), applied.scalar().alias("applied"))
    return _verdict(
        totals, "advisory", (F.col("wrong") == 0) & (F.col("applied") == 0),
        _text(F.col("wrong"), " differ from the cache, ", F.col("applied"), " were applied"),
    )


def cache_problem() -> Column:
    """Why a cache entry is not well formed, or null."""

    def unless(ok: Column, problem: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), problem)

    return F.coalesce(
        unless(F.col("norm_key") == norm_key("merchant"), "key of another merchant"),
        unless(F.col("category").isNull() | F.col("category").isin(S.CATEGORIES), "unknown category"),
        unless(F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0), "confidence out of range"),
        unless(F.col("provider").isin(S.PROVIDERS), "unknown provider"),
        unless(F.col("model") != "", "no model"),
        unless(F.col("generated").isNotNull(), "no date"),
    )


def check_cache(cache: DataFrame) -> DataFrame:
    """Cache entries are well formed."""
    totals = cache.agg(F.count(cache_problem()).alias("bad"), F.count("*").alias("n"))
    return _verdict(totals, "cache", F.col("bad") == 0, _text(F.col("n"), " cache entries"))


def check_all(checks: list[DataFrame]) -> DataFrame:
    """All verdicts in one table."""
    return reduce(DataFrame.unionByName, checks)
