"""Token ids in Arrow stream files of equal-length sequences.

A shard is a run of documents in ascending id order.  Its ids are one long row of numbers, cut
into sequences of ``length``; the file is an Arrow IPC stream whose record batches hold a fixed
number of sequences in fixed-size lists: ``ids`` (16 bits when the vocabulary allows), ``mask``
(one bit per id, unset for padding) and ``ends`` (one bit, set on the last id of a document).
All batches of a file have the same size in bytes, so sequence ``i`` lies at a computed place and
``SequenceFile`` returns it from the memory map without copying or reading anything else.
A second stream beside it lists the shard's documents.

``encode`` gives the ids of whole texts.  With a tokenizer of the one normalizer and pre-tokenizer
named in ``WORD_RULES`` it works by words, each encoded once: these rules never join or compose
anything across a space, nor across the place between a letter and closing punctuation at a word's
end (only letters of ``LETTER`` count here, which keep being one letter in lower case), and a word
of such letters needs no more than lower case before the model.  Every other word is encoded by the
tokenizer as it stands, and with any other tokenizer whole texts are.

Defined cases: a null text is empty and has only the end id; a null document id comes first; rows
that repeat an id are in the order of the first ``TIE_CHARS`` characters of their texts, then in that
of the table; texts are encoded whole, a very long one in a batch of its own; an empty table gives no
files and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import file_system, shared_dir, slices, staged

END_ID = 1
LENGTH = 2048
ROWS = 32  # sequences in a record batch
# documents and bytes of text of a shard, as means
DOCS_PER_SHARD = 4096
SHARD_BYTES = 1 << 24
KNOWN_PIECES = 3 << 18  # encoded pieces that a worker keeps
TIE_CHARS = 64
BATCH_BYTES = 1 << 21  # bytes of text encoded at once
MANIFEST = "path string, first_doc long, n_docs long, n_ids long"


# fixed values: the rules under which words can be encoded one by one
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
# letters that have one code point in either case and compose with nothing after them but marks
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
# ASCII without letters, digits, the apostrophe of contractions and what special tokens hold
CLOSING = r"!-&(-/:;?@\[-`{}~"
_CLOSED = rf"([{LETTER}])([{CLOSING}]+)([ \n]|$)"
_PLAIN = re.compile(rf"(?:[{LETTER}]+|[{CLOSING}]+)\Z")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    spec = json.loads(model.to_str())
    by_word = all(spec.get(k) == v for k, v in WORD_RULES.items()) and not any(
        " " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]
    )
    return model, {} if by_word else None


def _encode_pieces(model, pieces: list[str]) -> dict[str, bytes]:
    """Ids of pieces, as bytes of unsigned 32-bit numbers."""
    one, found, others = model.model.tokenize, {}, []
    for x in pieces:
        if _PLAIN.match(x):
            low = x.lower()
            low = low if low.isascii() else low.encode().decode("latin-1").translate(_LETTERS)
            found[x] = array("I", [t.id for t in one(low)]).tobytes()
        else:
            others.append(x)
    for x, e in zip(others, model.encode_batch_fast(others, add_special_tokens=False), strict=True):
        found[x] = array("I", e.ids).tobytes()
    return found


def encode(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of ids of each text."""
    model, known = _tokenizer(tokenizer)
    if known is None:
        coded = [e.ids for e in model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes
    # a line feed is white space to the tokenizer too
    apart = pc.replace_substring(pc.replace_substring_regex(texts, _CLOSED, r"\1 \2\3"), "\n", " ")
    pieces = pc.split_pattern(apart, " ")
    coded = pieces.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    fresh = _encode_pieces(model, [x for x in names if x not in known])
    room = KNOWN_PIECES - len(known)
    known.update(fresh)
    parts = list(map(known.__getitem__, names))
    for x in itertools.islice(fresh, room, None):
        del known[x]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    which = coded.indices.to_numpy()
    each = sizes[which]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.arange(total) + np.repeat(at[which] - (ends - each), each)]
    offsets = pieces.offsets.to_numpy()
    bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
    return ids, np.diff(bounds)


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length)),
    ])


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64())])


class _ShardWriter:
    """Cuts a stream of ids into sequences and writes them in batches of one size."""

    def __init__(self, fs, path: str, kind: pa.DataType, length: int):
        self.schema, self.kind, self.length = _schema(kind, length), kind.to_pandas_dtype(), length
        self.files = [fs.open_output_stream(path, compression=None), fs.open_output_stream(f"{path}.docs", compression=None)]
        self.out = pa.ipc.new_stream(self.files[0], self.schema)
        self.docs = pa.ipc.new_stream(self.files[1], _DOCS)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = self.n_docs = self.n_ids = 0
        self.first = None

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        if not self.n_docs:
            self.first = doc_ids[0].as_py()
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(sizes) - 1] = True
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(sizes)], schema=_DOCS))
        self.held.append((ids.astype(self.kind), ends))
        self.n_held, self.n_docs, self.n_ids = self.n_held + len(ids), self.n_docs + len(sizes), self.n_ids + len(ids)
        if self.n_held >= ROWS * self.length:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids, ends = (np.concatenate(x) for x in zip(*self.held, strict=True))
        step = ROWS * self.length
        stop = len(ids) if last else len(ids) // step * step
        for at in range(0, stop, step):
            n = min(step, stop - at)
            pad = step - n
            columns = [
                pa.array(np.pad(ids[at : at + n], (0, pad))), pa.array(np.arange(step) < n),
                pa.array(np.pad(ends[at : at + n], (0, pad))),
            ]
            lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held = [(ids[stop:], ends[stop:])]
        self.n_held = len(ids) - stop

    def close(self) -> None:
        if self.n_held:
            self._flush(last=True)
        for x in (self.out, self.docs, *self.files):
            x.close()


class SequenceFile:
    """Random access to the sequences of a shard; arrays are views of the mapped file."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        local = fs.type_name == "local"
        self.file = pa.memory_map(name) if local else fs.open_input_file(name)
        reader = pa.ipc.open_stream(self.file)
        self.schema = reader.schema
        self.length = self.schema.field("ids").type.list_size
        self.head = self.file.tell()
        message = pa.ipc.read_message(self.file)
        self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows
        self.step = self.file.tell() - self.head
        # a stream closes with a marker of 8 bytes
        self.n_batches = (self.file.size() - self.head - 8) // self.step

    def batch(self, i: int) -> pa.RecordBatch:
        if not 0 <= i < self.n_batches:
            raise IndexError(i)
        self.file.seek(self.head + i * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def __len__(self) -> int:
        return self.n_batches * self.rows

    def __getitem__(self, i: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of sequence ``i``."""
        batch = self.batch(i // self.rows)
        return batch.column("ids")[i % self.rows].values, batch.column("mask")[i % self.rows].values

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and document ends of each batch, without the padding."""
        for i in range(self.n_batches):
            batch = self.batch(i)
            mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
            ids, ends = batch.column("ids").flatten().to_numpy(), batch.column("ends").flatten().to_numpy(zero_copy_only=False)
            n = int(mask.sum())
            yield ids[:n], ends[:n]


def write_sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents; returns the shards: ``path, first_doc, n_docs, n_ids, start``.

    Range partitioning by id makes a shard of each partition.  Files have names of their own per
    attempt and only those of committed attempts are listed.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name, out = f"{uuid.uuid4().hex}.arrows", None
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                if out is None:
                    size = max(_tokenizer(tokenizer)[0].get_vocab_size(), end_id + 1)
                    out = _ShardWriter(fs, f"{root}/{name}", pa.uint16() if size <= 1 << 16 else pa.uint32(), length)
                ids, sizes = encode(part.column("text"), tokenizer)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                out.add(part.column("doc_id"), ids, sizes + 1)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "first_doc": pa.array([out.first], pa.int64()), "n_docs": [out.n_docs], "n_ids": [out.n_ids]}
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    shards = max(spark.sparkContext.defaultParallelism, -(-n // DOCS_PER_SHARD), -(-size // SHARD_BYTES))
    # rows that repeat an id, equal ones too, are spread over shards
    keys = ["doc_id", "_start", "_tie"]
    texts = texts.withColumns({"_start": F.substring("text", 1, TIE_CHARS), "_tie": F.monotonically_increasing_id()})
    ordered = texts.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("first_doc").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard
    return staged(ordered.mapInArrow(write, MANIFEST)).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = file_system(f"{row['path']}.docs")
                with pa.ipc.open_stream(fs.open_input_stream(name, compression=None)) as listed:
                    table = listed.read_all()
                held, crcs, sizes = [], [], []
                for ids, ends in SequenceFile(row["path"]).runs():
                    ids, at = ids.astype("<u4"), 0
                    for end in np.flatnonzero(ends) + 1:
                        held.append(ids[at:end])
                        crcs.append(functools.reduce(lambda c, x: zlib.crc32(x, c), held, 0))
                        sizes.append(sum(map(len, held)))
                        held, at = [], end
                    held.append(ids[at:])
                if sum(map(len, held)) or sizes != table.column("n_ids").to_pylist():
                    raise ValueError(f"{row['path']} does not hold the documents of its list")
                starts = row["start"] + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": table.column("doc_id").combine_chunks(), "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    each = shards.repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism), "path")
    return each.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
