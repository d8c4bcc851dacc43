"""Comparing large tables by digests of buckets of rows.

Rows fall into buckets by a hash of their key columns.  A bucket's digest is its number of rows and
the sum of their 64-bit hashes, which does not depend on their order, so it is a map-side combined
aggregate.  Tables whose digests agree need no comparison of rows; otherwise only the buckets that
differ are read and compared exactly.  A table written by ``write_digested`` keeps its digests and
has a folder per bucket, so that the rows of equal buckets are never read.

A row that was changed without regard to the hash goes unnoticed with a chance of 2**-64.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators import checks
from ledgerspark.sinks.staging import read_by, stage, write_by

BUCKETS = 1024
_BUCKET = "_bucket"
_LOW = (1 << 32) - 1


def _text(columns: list[str]) -> Column:
    """All values as one text; nulls are written, so they cannot trade places with values."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(_text(key)), F.lit(buckets)).cast("int").alias(_BUCKET)


@dataclass(frozen=True)
class Digested:
    """A table with its buckets: ``rows`` has the column ``_bucket``, ``digests`` one line per bucket.

    ``key`` and ``buckets`` say how the buckets were cut; only tables cut alike can be compared.
    """

    rows: DataFrame
    digests: DataFrame
    key: tuple[str, ...]
    buckets: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != _BUCKET]


def _digests(rows: DataFrame) -> DataFrame:
    h = F.xxhash64(_text(sorted(c for c in rows.columns if c != _BUCKET)))
    # halves, whose sums fit a bigint for two billion rows of a bucket
    return rows.select(_BUCKET, h.alias("h")).groupBy(_BUCKET).agg(
        F.count("*").alias("n"),
        F.sum(F.shiftright("h", 32)).alias("high"),
        F.sum(F.col("h").bitwiseAND(F.lit(_LOW))).alias("low"),
    )


def digested(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> Digested:
    """A table that is not stored; reading its digests computes it once, its rows once more."""
    rows = df.withColumn(_BUCKET, _bucket(key, buckets))
    return Digested(rows, _digests(rows), tuple(key), buckets)


def write_digested(path: str, df: DataFrame, key: list[str], buckets: int = BUCKETS) -> Digested:
    """Write ``df`` by buckets, then the digests of what was written, under the new folder ``path``."""
    spark = df.sparkSession
    placed = df.withColumn(_BUCKET, _bucket(key, buckets))
    # rebalancing splits a bucket of very many rows (one key may be most of a table) over tasks
    rows = write_by(placed.hint("rebalance", _BUCKET), _BUCKET, path)
    facts = spark.createDataFrame([(list(key), buckets)], "key array<string>, buckets int")
    facts.coalesce(1).write.mode("errorifexists").json(f"{path}/facts")
    return Digested(rows, stage(_digests(rows).coalesce(1), f"{path}/digests"), tuple(key), buckets)


def read_digested(spark: SparkSession, path: str) -> Digested:
    """A table written by ``write_digested``."""
    facts = spark.read.json(f"{path}/facts").first()
    digests = spark.read.parquet(f"{path}/digests")
    return Digested(read_by(spark, path), digests, tuple(facts["key"]), facts["buckets"])


def differing_buckets(a: Digested, b: Digested) -> list[int]:
    """Buckets whose digests differ; there are at most ``buckets`` of them."""
    if (a.key, a.buckets) != (b.key, b.buckets):
        raise ValueError("the tables were cut into buckets in different ways")
    if set(a.columns) != set(b.columns):
        raise ValueError("the tables have different columns")
    return sorted(r[0] for r in checks.ledger_diff(a.digests, b.digests).select(_BUCKET).distinct().collect())


def digest_diff(a: Digested, b: Digested) -> DataFrame:
    """``checks.ledger_diff`` of the two tables, which reads the rows of differing buckets only."""
    wanted = F.col(_BUCKET).isin(differing_buckets(a, b))
    left, right = (t.rows.filter(wanted).select(*a.columns) for t in (a, b))
    return checks.ledger_diff(left, right)


def check_same_digested(a: Digested, b: Digested, name: str) -> DataFrame:
    """Two tables have the same rows, as often; of equal tables only the digests are read."""
    return checks.count_verdict(digest_diff(a, b), name)
