"""Exact and possible duplicates, row status and review reasons.

The retained row of a group is the first one in processing order (``ord``), whatever the
partitioning.  All groups are settled by one shuffle:

* rows that cannot be parsed belong to no group and are spread by their id;
* ordinary groups ``(merchant, date, cents)`` meet in one partition;
* a group with a large share of all rows never does: its first rows come from a map-side
  combined aggregate over at most ``TOP_KEYS`` groups, are broadcast, and its rows are spread
  by invoice, or by id where even one invoice is that frequent.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import amount_error, date_error, is_blank, threshold_label
from ledgerspark.operators.skew import HOT_ROWS, TOP_KEYS, heavy_keys

NEAR = ["merchant", "bill_date", "cents"]
EXACT = [*NEAR, "invoice"]


def is_parsed() -> Column:
    return F.col("bill_date").isNotNull() & F.col("cents").isNotNull()


def hot_groups(rows: DataFrame, hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the ``(merchant, date, cents)`` groups that must not meet in one partition."""
    return heavy_keys(rows, F.when(is_parsed(), F.xxhash64(*NEAR)), hot_rows)


def _first_of_hot_groups(rows: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """First row of every heavy near group, and of the most frequent exact groups in them."""
    groups = (
        rows.filter(is_parsed() & F.xxhash64(*NEAR).isin(hot))
        .groupBy(EXACT)
        .agg(F.min(F.struct("ord", "id")).alias("_first"), F.count("*").alias("_n"))
    )
    near = groups.groupBy(NEAR).agg(F.min("_first").alias("_hot_near"))
    exact = (
        groups.orderBy(F.desc("_n"), *EXACT)
        .limit(TOP_KEYS)
        .select(*EXACT, F.col("_first").alias("_hot_exact"))
    )
    return near, exact


def mark_duplicates(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Add ``duplicate_of`` and ``possible_of`` (ids, or null).

    ``hot`` comes from ``hot_groups``; any list gives the same result.
    """
    if hot:
        near, exact = _first_of_hot_groups(rows, hot)
        keyed = rows.join(F.broadcast(near), NEAR, "left").join(F.broadcast(exact), EXACT, "left")
    else:
        none = F.lit(None).cast(rows.select(F.struct("ord", "id")).schema[0].dataType)
        keyed = rows.withColumn("_hot_near", none).withColumn("_hot_exact", none)
    lane = (
        F.when(~is_parsed() | F.col("_hot_exact").isNotNull(), F.xxhash64("id"))
        .when(F.col("_hot_near").isNotNull(), F.xxhash64("invoice"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    group = [*NEAR, "_lane"]
    me = F.struct("ord", "id")
    # one exchange on the near key and one sort serve both windows
    laid_out = (
        keyed.withColumn("_lane", lane)
        .repartition(*group)
        .sortWithinPartitions(*group, "invoice")
    )
    firsts = laid_out.withColumn(
        "_exact_first", F.min(me).over(W.partitionBy(*group, "invoice"))
    ).withColumn("_near_first", F.min(me).over(W.partitionBy(*group)))
    exact_id = F.coalesce("_hot_exact", "_exact_first")["id"]
    near_id = F.coalesce("_hot_near", "_near_first")["id"]
    return (
        firsts.withColumn("duplicate_of", F.when(is_parsed() & (exact_id != F.col("id")), exact_id))
        .withColumn(
            "possible_of",
            F.when(
                is_parsed() & F.col("duplicate_of").isNull() & (near_id != F.col("id")), near_id
            ),
        )
        .drop("_lane", "_hot_near", "_hot_exact", "_exact_first", "_near_first")
    )


def assign_status(rows: DataFrame) -> DataFrame:
    """Put every row into exactly one of clean, duplicate and unparseable."""
    return rows.withColumn(
        "status",
        F.when(~is_parsed(), "unparseable")
        .when(F.col("duplicate_of").isNotNull(), "duplicate")
        .otherwise("clean"),
    )


def high_reason(high_cents: int) -> str:
    """The reason of a row that reaches the limit."""
    return S.R_HIGH_PREFIX + threshold_label(high_cents)


def build_reasons(rows: DataFrame, high_cents: int) -> DataFrame:
    """Add the ordered list of review reasons."""
    limit = F.lit(high_cents).cast("decimal(38,0)")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("category") == S.UNCATEGORISED, S.R_UNMAPPED),
            amount_error("amount_raw", F.col("cents")),
            date_error("date_raw", F.col("bill_date")),
            F.concat(F.lit(S.R_EXACT_PREFIX), "duplicate_of"),
            F.concat(F.lit(S.R_POSSIBLE_PREFIX), "possible_of", F.lit(S.R_POSSIBLE_SUFFIX)),
            F.when(F.abs("cents") >= limit, high_reason(high_cents)),
        )
    )
    return rows.withColumn("reasons", reasons)
