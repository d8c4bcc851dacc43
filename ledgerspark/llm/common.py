"""Shared helpers: the folder that all machines see, staged tables, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.skew import BROADCAST_ROWS, fits_broadcast
from ledgerspark.sinks.staging import stage

# bytes of text that a Python worker turns into arrays at once (a longer text goes alone)
BATCH_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster the setting
    is required, because a machine-local folder would lose the rows of the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, survives executors."""
    return stage(df, shared_dir(df.sparkSession))


def small(df: DataFrame) -> DataFrame:
    """Mark a lookup side for broadcast if its counted rows allow; else Spark shuffles it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def crc_mod(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds at most ``limit`` bytes together."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


__all__ = [
    "BATCH_BYTES", "BROADCAST_ROWS", "crc_mod", "file_system", "shared_dir", "slices", "small",
    "staged",
]
