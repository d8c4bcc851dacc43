"""Gap-free row numbers in processing order, without a global sort in one task.

One range sort puts the rows in order over the shuffle partitions.  A row's number is its place in
its partition plus the rows of the partitions before, of which there is one count per partition.
Whatever the keys look like, no task gets more than its part of the rows.
"""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# where a row stands: its file, sheet and row
ORDER = ["ord.file_ix", "ord.sheet_ix", "ord.source_row"]


def number_rows(df: DataFrame, tie: list[str], name: str = "n", order: list[str] = ORDER) -> DataFrame:
    """Add ``name``: 1, 2, … by ``order`` and then the ``tie`` columns, which must tell rows apart.

    The sorted rows are kept, because their counts and their numbers must come from the same cut
    into partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*order, *tie]]
    placed = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return (
        placed.withColumn(name, place).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")
    )
