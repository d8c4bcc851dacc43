"""WARC archives compressed with Zstandard: a shared dictionary and one frame per record.

An archive starts with a skippable frame that holds the dictionary, followed by one Zstandard
frame for each record, so that a record can be fetched and decoded on its own.  Pages become
``response`` records; a page whose payload of at least ``MIN_REVISIT`` bytes is already held by a
page with a smaller id becomes a ``revisit`` record that names it and has no payload.  Both keep
the HTTP head, whose length field gives the size of the full payload.

The reader streams an archive frame by frame, so its memory is bounded by the largest record, and
checks the magic numbers, the version line, the header fields, the lengths and both digests.

Defined cases: a null payload is empty; a null url gives no target field, a null page id the id
``null`` (such a page is a response and no page refers to it); rows that repeat the smallest id of
a payload are all responses; an empty table gives no archive and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import file_system, shared_dir, small, staged

MIN_REVISIT = 100
# the dictionary is trained on the first bytes of this many pages, those of smallest id hash
SAMPLE_PAGES = 256
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 32_768
LEVEL = 3

# fixed values of the two public formats
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"

RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])
MANIFEST = "path string, records long, bytes long"


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if there is too little to learn."""
    # the ids first: sorting the payloads would send a sample of every task to the driver
    ids = (
        pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
        .select("page_id")
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(SAMPLE_PAGES)
        .collect()
    )
    rows = (
        pages.where(F.col("page_id").isin([r["page_id"] for r in ids]) & F.col("html").isNotNull())
        .select("page_id", F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8").alias("s"))
        .orderBy("page_id", "s")
        .limit(SAMPLE_PAGES)
        .collect()
    )
    samples = [bytes(r["s"]) for r in rows if r["s"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with ``payload``, ``digest`` and, for later copies of a payload, ``refers_to``."""
    bodies = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # only digests that occur twice are kept; where they are few, no payload is shuffled
    firsts = staged(
        bodies.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    later = F.col("page_id") > F.col("_first")
    return bodies.join(small(firsts), F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(later, F.col("_first")).alias("refers_to")
    )


def _field(text: str) -> str:
    """A header value: one line, with line ends and other control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text).strip()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _field(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The row of a record, after checking its form, lengths and digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError(f"not a {VERSION} record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "warc-block-digest", "content-length"):
        if name not in fields:
            raise WarcError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block has not the {length} bytes of its header")
    block = rest[:length]
    if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block does not match its digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise WarcError("the HTTP head has no single length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != int(sizes[0]) or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload does not match its length and digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"a {kind} record of unknown form")
    number = lambda x: None if x == "null" else int(x)
    named = lambda x: number(fields[x].removeprefix(f"<{ID_PREFIX}").removesuffix(">"))
    return {
        "page_id": named("warc-record-id"), "payload_bytes": int(sizes[0]), "payload_digest": digest,
        "record_type": kind, "refers_to": named("warc-refers-to") if kind == "revisit" else None,
        "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


def _dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def read_frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive; reads the dictionary from the leading skippable frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise WarcError("the archive does not start with a dictionary frame")
    data = stream.read(size)
    if len(data) != size:
        raise WarcError("the dictionary frame is cut off")
    if data[:4] == FRAME_MAGIC:  # the format lets the dictionary itself be compressed
        data = zstandard.ZstdDecompressor().decompress(data)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary_of(data))
    held = b""
    while held or (held := stream.read(1 << 18)):
        while len(held) < 4 and (more := stream.read(1 << 18)):
            held += more
        if held[:4] != FRAME_MAGIC:
            raise WarcError("a record does not start a frame")
        frame, parts = reader.decompressobj(read_across_frames=False), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            if not (held := stream.read(1 << 18)):
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def write_archives(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder; returns ``path, records, bytes`` of each.

    Each partition of the pages, as read, becomes an archive, so payloads are not moved.

    Files have names of their own per attempt, and only those of attempts that Spark committed
    are listed, so a task that is run again after a loss leaves no trace in the result.
    """
    spark = pages.sparkSession
    folder, dictionary = shared_dir(spark), train_dictionary(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        path, out, count = f"{root}/{uuid.uuid4().hex}.warc.zst", None, 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary_of(dictionary), write_checksum=True)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out.write(packer.compress(record_bytes(*(x.as_py() for x in row))))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return staged(rows.mapInArrow(write, MANIFEST)).withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives, with their payloads; fails on a broken archive."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = file_system(row["folder"])
                held, size, count = [], 0, 0
                with fs.open_input_stream(row["path"], compression=None) as stream:
                    for frame in read_frames(stream):
                        held.append(parse_record(frame))
                        size += len(frame)
                        count += 1
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if count != row["records"]:
                    raise WarcError(f"{row['path']} has {count} records, not {row['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    each = archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism), "path")
    return each.select("path", "records", "folder").mapInArrow(read, RECORDS)
