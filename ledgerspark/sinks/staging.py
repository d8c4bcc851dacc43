"""Writing an intermediate table that several results are derived from."""

import json

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a new path on shared storage and read it from there.

    Spark would otherwise compute the table again for every result that uses it.  Unlike a
    cached table the written one survives the loss of executors, and its files are split over
    many tasks again.  Worth it for decoded cells and for cleaned records.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by(df: DataFrame, column: str, path: str) -> DataFrame:
    """Write a table with a folder per value of ``column``, and its schema, to a new path."""
    df.write.mode("errorifexists").partitionBy(column).parquet(f"{path}/rows")
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
    schema.coalesce(1).write.mode("errorifexists").text(f"{path}/schema")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def read_by(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_by``, also if it has no rows."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain path, for tasks that write files themselves."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri
