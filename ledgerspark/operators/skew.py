"""Joins and groupings that stay balanced when one key holds a large share of all rows.

``heavy_keys`` finds such keys with a mergeable frequent-items sketch: one pass, no shuffle of
the data, and never more than ``TOP_KEYS`` keys out, so the driver can always hold them.
The sketch only decides which of two exact ways a key takes; it never changes a result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the sketch keeps this many candidate keys; a key holding more than about 1/4500 of the rows
# is always among them
TRACKED_KEYS = 16_384
TOP_KEYS = 4096
SKETCH_MERGE_WIDTH = 256

# a key is worth splitting only when it has at least this many rows
HOT_ROWS = 100_000
SALTS = 64

# a lookup table up to this many rows is broadcast, a larger one is joined by shuffle
BROADCAST_ROWS = 100_000


def heavy_keys(df: DataFrame, key: Column, hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with at least ``hot_rows`` rows, at most ``TOP_KEYS`` of them.

    Runs one small job.  Sketches are merged in two steps so that no single task receives one
    per input partition.  Rows without a key are left to the sketch: a filter here would be
    pushed below the projection that computes the key and compute it twice.
    """
    sketches = (
        df.select(key.alias("_key"), (F.spark_partition_id() % SKETCH_MERGE_WIDTH).alias("_lane"))
        .groupBy("_lane")
        .agg(F.expr(f"approx_top_k_accumulate(_key, {TRACKED_KEYS})").alias("_sketch"))
        # grouped by a constant: without a group, a partition that got no sketch would fail
        .groupBy(F.lit(1))
        .agg(F.expr(f"approx_top_k_combine(_sketch, {TRACKED_KEYS})").alias("_sketch"))
    )
    top = sketches.select(F.inline(F.expr(f"approx_top_k_estimate(_sketch, {TOP_KEYS})")))
    found = top.filter(F.col("item").isNotNull() & (F.col("count") >= hot_rows))
    return [r["item"] for r in found.collect()]


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a lookup table is small enough to broadcast; counts at most one row too many."""
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return rows <= BROADCAST_ROWS


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: str,
    rows: int | None = None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to a lookup table with one row per ``on`` key.

    A table of checked small size is broadcast.  Otherwise both sides are shuffled on the key;
    keys that are heavy on the left are cut into ``SALTS`` slices by a hash of ``spread`` and
    only their lookup rows are repeated per slice.  Rows without a key are spread as well.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, spread, how, hot_rows)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The shuffled form of ``lookup_join``."""
    key = F.xxhash64(*on)
    lane = F.xxhash64(spread)
    zero = F.lit(0).cast("bigint")
    hot = heavy_keys(left, F.when(_all_set(on), key), hot_rows)
    is_hot = key.isin(hot) if hot else F.lit(False)
    left_salted = left.withColumn(
        "_salt",
        F.when(~_all_set(on), lane).when(is_hot, F.pmod(lane, F.lit(SALTS))).otherwise(zero),
    )
    if hot:
        slices = F.sequence(zero, F.lit(SALTS - 1).cast("bigint"))
        right_salted = right.withColumn(
            "_salt", F.explode(F.when(is_hot, slices).otherwise(F.array(zero)))
        )
    else:
        right_salted = right.withColumn("_salt", zero)
    return left_salted.join(right_salted, [*on, "_salt"], how).drop("_salt")


def _all_set(on: list[str]) -> Column:
    cond = F.lit(True)
    for name in on:
        cond = cond & F.col(name).isNotNull()
    return cond
