"""Pages of a large sorted table, read without sorting it again.

``write_pages`` sorts once: a range exchange puts the rows in order over many parts, and each row
is stored with its place in its part.  Beside the rows stands one line per part with its number
of rows and the number of rows before it.  Any page, the last one too, is then a filter on the few
parts that overlap it and, inside them, on a range of places that the file statistics prune.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark.sinks.staging import read_by, stage, write_by

PART_ROWS = 1_000_000  # rows aimed at per part
_PART, _AT = "_part", "_at"
# the place in a partition is in the low bits of monotonically_increasing_id
_PLACE = (1 << 33) - 1


def write_pages(df: DataFrame, order: list[Column], path: str, part_rows: int = PART_ROWS) -> None:
    """Write ``df`` in the total order ``order`` under the new folder ``path``.

    Because the order tells all rows apart, parts are cut evenly whatever the first keys are.
    """
    parts = max(1, -(-df.count() // part_rows))
    placed = (
        df.repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id())
        .sortWithinPartitions(_PART, *order)
        .withColumn(_AT, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    )
    sizes = write_by(placed, _PART, path).groupBy(_PART).agg(F.count("*").alias("rows"))
    # one line per part
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    stage(starts.coalesce(1), f"{path}/parts")


def page_count(spark: SparkSession, path: str, size: int = 200) -> int:
    """Number of pages, from the part lines alone."""
    rows = spark.read.parquet(f"{path}/parts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return -(-rows // size)


def read_page(spark: SparkSession, path: str, n: int, size: int = 200) -> DataFrame:
    """Page ``n`` (from 0) in order; a page behind the last one is empty."""
    if n < 0 or size < 1:
        raise ValueError("a page has a number from 0 and at least one row")
    first, end = n * size, (n + 1) * size
    parts = spark.read.parquet(f"{path}/parts")
    # at most as many as the page has rows: parts without rows have no line
    hit = parts.filter((F.col("start") < end) & (F.col("start") + F.col("rows") > first)).collect()
    inside = [
        (F.col(_PART) == p["_part"]) & F.col(_AT).between(first - p["start"], end - 1 - p["start"])
        for p in hit
    ]
    parts_read = F.col(_PART).isin([p["_part"] for p in hit])
    found = read_by(spark, path).filter(parts_read & reduce(Column.__or__, inside, F.lit(False)))
    return found.orderBy(_PART, _AT).drop(_PART, _AT)
