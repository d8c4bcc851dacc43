"""Remove repeated passages: bytes covered by a string of ``LENGTH`` bytes that starts earlier.

Position order is document order, then place in the text.  A string's earlier start is a longest
previous factor of at least ``LENGTH``: in the suffix array, sorted by the first ``LENGTH`` bytes
and then by position, a suffix has an earlier match of that length exactly if the suffix before it
(its previous smaller position among equals) agrees in ``LENGTH`` bytes.

Sorting the suffixes of all positions is not affordable, so a sieve decides most of them first.

1. Each window of ``LENGTH`` bytes names an anchor: the smallest hash of the ``GRAM``-byte strings
   in it.  Equal windows name equal anchors at equal places.  The windows of one anchor are a run
   of consecutive starts; a run is shuffled as two hashes (anchor, and all bytes of its windows).
2. A run whose anchor occurs once has no earlier match.  A run that equals an earlier run in
   anchor and bytes is repeated as a whole.  The first run of its kind, when the anchor also has
   other runs, is undecided.
3. The windows of undecided runs are the suffixes that are sorted.  Runs of one anchor meet in one
   task, many anchors at a time, where the suffix array of their bytes is built.  The runs of an
   anchor with more than ``GROUP`` different runs are cut into parts at fixed distances from the
   anchor; a part that equals an earlier one is repeated as a whole.  All windows at the distances
   of a part share its core, so a first part whose core no other first part has is decided too.
   The others meet in one task per core, many cores at a time, where the suffix array is built.
   Those of a core with more than ``GROUP // 2`` first parts are cut into narrower parts, which are
   treated alike.  Only what such narrow cores leave is spread out as one row per suffix: these are
   range-partitioned by bytes and position, so that they are spread over tasks wherever their bytes
   agree.  The first row of a partition compares with the last one of the one before.

The removed bytes are the union of the repeated windows.  Defined cases: a null text is empty;
texts of less than ``LENGTH`` bytes lose nothing; a null id comes first; rows that repeat an id
with the same text are the same document (both lose what that document loses), with other texts
they follow each other in the order of a hash of the text; very long texts are read in pieces that
overlap, so memory is bounded by the piece and the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import slices, small, staged
from ledgerspark.operators.skew import BROADCAST_ROWS, fits_broadcast, lookup_join

LENGTH = 100
GRAM = 32
PIECE = 1 << 19
GROUP = 128  # different runs of an anchor that one task may take
PART = 16  # windows of a part of a run of a more frequent anchor
NARROW = 4  # windows of a part of such a part, where its core is frequent too
RUNS_PER_TASK_GROUP = 2048

_TABLE = np.random.default_rng(30).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = [np.uint64(int(x) | 1) for x in np.random.default_rng(31).integers(1, 2**63, 6, dtype=np.uint64)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(values: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes, by doubling the length."""
    h, size = values, 1
    for factor in _FACTOR[: GRAM.bit_length() - 1]:
        h = h[:-size] * factor + h[size:]
        size *= 2
    return _mixed(h)


def anchors(grams: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window start, the place of the window's anchor (the leftmost on ties)."""
    # 40 bits of the hash choose, the low bits carry the place
    best = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(texts: list[bytes], length: int = LENGTH, bodies: bool = True) -> dict[str, np.ndarray]:
    """The runs of a batch of texts: ``text`` index, ``lo``, ``hi`` (window starts), ``anchor`` and ``body``.

    The texts lie one after the other in a buffer; windows across texts are left out.
    """
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi", "anchor", "body")}
    if len(buffer) < length:
        return empty
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    values = _TABLE[buffer]
    grams = gram_hashes(values)
    at = anchors(grams, length)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= (starts + sizes)[owner]
    change = (np.diff(at) != 0) | (np.diff(owner) != 0) | (np.diff(inside.astype(np.int8)) != 0)
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = inside[first]
    lo, hi = first[keep], last[keep]
    if not len(lo):
        return empty
    place, text = at[lo], owner[lo]
    found = {"text": text, "lo": lo - starts[text], "hi": hi - starts[text], "anchor": grams[place].view(np.int64)}
    if not bodies:
        return found
    # a prefix sum gives the hash of any range of bytes, whatever its place
    n = len(values)
    falling = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * falling, dtype=np.uint64)])
    rising = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
    body = (total[hi + length] - total[lo]) * rising[lo]
    shape = ((hi - lo) * 1024 + (place - lo)).astype(np.uint64)
    return found | {"body": _mixed(body + shape * _FACTOR[0]).view(np.int64)}


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that share ``length - 1`` bytes, so that each window is in one piece."""
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        yield at, text[at : at + PIECE + length - 1]


KEY = ["doc_id", "tag"]


def documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, text)`` with the text as UTF-8 bytes, empty where it is null.

    ``tag`` is one more than a hash of the text where rows repeat an id, and 0 elsewhere.
    """
    twice = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_id")
    texts = docs.select("doc_id", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    met = texts.join(small(staged(twice.withColumn("_again", F.lit(True)))), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    tag = F.when(F.col("_again"), F.crc32("text") + 1).otherwise(F.lit(0).cast("long"))
    return met.select("doc_id", tag.alias("tag"), "text")


def once(texts: DataFrame) -> DataFrame:
    """``texts`` with each document in one row: rows that repeat an id with the same text are one."""
    again = texts.where("tag <> 0").dropDuplicates([*KEY, "text"])
    return texts.where("tag = 0").unionByName(again)


def document_runs(texts: DataFrame, length: int = LENGTH, bodies: bool = True) -> DataFrame:
    """``(doc_id, tag, span, anchor, body)`` of all documents; ``span`` is ``lo * 128 + hi - lo``.

    Without ``bodies``, only ``anchor``.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                whole = part.column("text").to_pylist()
                if len(whole) == 1:
                    groups = [[(0, at, piece)] for at, piece in _pieces(whole[0], length)]
                else:
                    groups = [[(i, 0, t) for i, t in enumerate(whole)]]
                for group in groups:
                    found = runs([piece for _, _, piece in group], length, bodies)
                    anchor = pa.array(found["anchor"])
                    if not bodies:
                        yield pa.RecordBatch.from_arrays([anchor], ["anchor"])
                        continue
                    which = pa.array(np.array([i for i, _, _ in group])[found["text"]])
                    lo = found["lo"] + np.array([at for _, at, _ in group])[found["text"]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(which), part.column("tag").take(which), pa.array(lo * 128 + found["hi"] - found["lo"]), anchor, pa.array(found["body"])],
                        [*KEY, "span", "anchor", "body"],
                    )

    schema = f"doc_id {kind}, tag long, span long, anchor long, body long" if bodies else "anchor long"
    return texts.mapInArrow(read, schema)


def judge_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, tag, lo, hi, anchor, kinds, state)``: runs of anchors that occur more than once.

    ``state`` is ``repeated`` or ``open``; runs that are decided as first and only are left out.
    """
    many = document_runs(texts, length, bodies=False).groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("_c"))
    many = many.where("_c > 1").select("_anchor")
    kept = staged(document_runs(texts, length).join(many, F.col("anchor") == F.col("_anchor"), "left_semi"))
    place = F.struct(*KEY, "span")
    firsts = kept.groupBy(F.col("anchor").alias("_anchor"), F.col("body").alias("_body")).agg(F.min(place).alias("_first"))
    kinds = firsts.groupBy(F.col("_anchor").alias("_of")).agg(F.count(F.lit(1)).alias("kinds"))
    known = kept.join(firsts, (F.col("anchor") == F.col("_anchor")) & (F.col("body") == F.col("_body")))
    known = known.join(kinds, F.col("anchor") == F.col("_of"))
    state = F.when(place > F.col("_first"), "repeated").when(F.col("kinds") > 1, "open")
    lo, hi = F.expr("span div 128"), F.expr("span div 128 + span % 128")
    return known.select(*KEY, lo.alias("lo"), hi.alias("hi"), "anchor", "kinds", state.alias("state")).where("state is not null")


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` with compressed bytes, which is what the joins shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                small_texts = pa.array([made.compress(t) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), small_texts], [*KEY, "text"])

    return texts.select(*KEY, "text").mapInArrow(pack, texts.select(*KEY, "text").schema)


def open_runs(texts: DataFrame, judged: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(anchor, kinds, doc_id, tag, lo, bytes)``: the open runs with the bytes of their windows."""
    # a set, because rows that repeat an id with the same text have each run several times
    spans = judged.where("state = 'open'").groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi", "anchor", "kinds")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "spans")
    rows = packed(once(texts)).join(spans, _same()).select(*KEY, "text", "spans")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                text = unpack.decompress(batch.column("text")[i].as_py())
                spans = batch.column("spans")[i].values
                lo, hi = (spans.field(x).to_numpy() for x in ("lo", "hi"))
                parts = pa.array([text[a : b + length] for a, b in zip(lo, hi, strict=True)], pa.binary())
                index = pa.array(np.full(len(lo), i))
                yield pa.RecordBatch.from_arrays(
                    [spans.field("anchor"), spans.field("kinds"), batch.column("doc_id").take(index), batch.column("tag").take(index), spans.field("lo"), parts],
                    ["anchor", "kinds", *KEY, "lo", "bytes"],
                )

    return rows.mapInArrow(cut, f"anchor long, kinds long, doc_id {kind}, tag long, lo long, bytes binary")


def repeated_in_groups(found: DataFrame, length: int = LENGTH, key: str = "anchor") -> DataFrame:
    """``(doc_id, tag, a, b)``: repeated bytes of open runs, from suffix arrays of whole anchors.

    ``found`` has all open runs of each of its anchors (or all first parts of each ``key``).
    """
    groups = max(1, -(-found.count() // RUNS_PER_TASK_GROUP))
    kind = found.schema["doc_id"].dataType.simpleString()

    def sort(table: pa.Table) -> pa.Table:
        # document order; nulls come first, as in the order of the tables
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("tag", "ascending"), ("lo", "ascending")], null_placement="at_start"))
        parts = table.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        run = np.repeat(np.arange(len(parts)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(parts), np.uint8), length)
        suffix = np.ascontiguousarray(views[starts[run] + step])
        # the suffix array; a stable sort keeps equal suffixes in the order of their positions
        order = np.argsort(suffix.view(f"V{length}").ravel(), kind="stable")
        ordered = suffix[order]
        hit = np.sort(order[1:][(ordered[1:] == ordered[:-1]).all(1)])
        # hits next to each other in one run are one range
        new = np.append(True, (np.diff(hit) != 1) | (np.diff(run[hit]) != 0))[: len(hit)]
        first, last = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
        base = table.column("lo").to_numpy()[run[first]]
        index = pa.array(run[first])
        return pa.table({
            "doc_id": table.column("doc_id").take(index), "tag": table.column("tag").take(index),
            "a": pa.array(base + step[first]), "b": pa.array(base + step[last] + length),
        })

    grouped = found.select(F.pmod(F.col(key), F.lit(groups)).alias("g"), *KEY, "lo", "bytes").groupBy("g")
    return grouped.applyInArrow(sort, f"doc_id {kind}, tag long, a long, b long")


def run_parts(found: DataFrame, length: int = LENGTH, width: int = PART) -> DataFrame:
    """``(doc_id, tag, lo, bytes, core)``: the runs cut where the distance to the anchor is a multiple
    of ``width``, so that runs which agree around the anchor have equal parts there.

    ``core`` is a hash of the distances and of the bytes that all windows at these distances have in
    common, whether the part has all of them or not.  Equal windows have equal distances to their
    anchors and thus lie in parts of equal cores; two windows of one part are never equal.
    """
    kind = found.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = part.column("bytes").to_pylist()
                sizes = np.array([len(t) for t in texts])
                at = np.cumsum(sizes) - sizes
                place = anchors(gram_hashes(_TABLE[np.frombuffer(b"".join(texts), np.uint8)]), length)[at] - at
                rows, shift, pieces, step, skip = [], [], [], [], []
                for i, (text, far) in enumerate(zip(texts, place, strict=True)):
                    count = len(text) - length + 1
                    # windows near the anchor end first: cuts where far - window passes a multiple
                    edges = [0, *range(int(far % width) + 1, count, width), count]
                    for a, b in zip(edges, edges[1:], strict=False):
                        rows.append(i)
                        shift.append(a)
                        pieces.append(text[a : b + length - 1])
                        step.append(int(far - a) // width)
                        skip.append(int(far - a) % width)
                index = pa.array(rows)
                lo = part.column("lo").to_numpy()[rows] + np.array(shift)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(index), part.column("tag").take(index), pa.array(lo), pa.array(pieces, pa.binary()), pa.array(step, pa.int32()), pa.array(skip, pa.int32())],
                    [*KEY, "lo", "bytes", "step", "skip"],
                )

    parts = found.select(*KEY, "lo", "bytes").mapInArrow(cut, f"doc_id {kind}, tag long, lo long, bytes binary, step int, skip int")
    common = F.substring("bytes", F.col("skip") + 1, F.lit(length - width + 1))
    return parts.select(*KEY, "lo", "bytes", F.xxhash64("step", common).alias("core"))


def repeated_when_spread(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, tag, a, b)``: repeated bytes of open runs of very frequent anchors."""
    decided = []
    for width in (PART, NARROW):
        parts = staged(run_parts(found, length, width))
        place = F.struct(*KEY, "lo")
        # equal bytes have equal cores
        firsts = parts.groupBy(F.col("bytes").alias("_bytes")).agg(F.min(place).alias("_first"), F.min("core").alias("core"))
        firsts = staged(firsts)
        later = parts.drop("core").join(firsts, F.col("bytes") == F.col("_bytes")).where(place > F.col("_first"))
        decided.append(later.select(*KEY, F.col("lo").alias("a"), (F.col("lo") + F.octet_length("bytes")).alias("b")))
        undecided = staged(undecided_parts(firsts))
        decided.append(repeated_in_groups(undecided.where(F.col("kinds") <= GROUP // 2), length, "core"))
        found = undecided.where(F.col("kinds") > GROUP // 2)
    single = repeated_suffixes(suffixes(found, length))
    decided.append(single.select(*KEY, F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    return reduce(DataFrame.union, decided)


def undecided_parts(firsts: DataFrame) -> DataFrame:
    """``(doc_id, tag, lo, bytes, core, kinds)``: first parts whose core other first parts have as well;
    ``kinds`` is how many have it.
    """
    shared = staged(firsts.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    rows = BROADCAST_ROWS if fits_broadcast(shared) else None
    met = lookup_join(firsts, shared, ["core"], "_bytes", rows, "inner")
    return met.select("_first.*", F.col("_bytes").alias("bytes"), "core", "kinds")


def suffixes(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(suffix, doc_id, tag, at)``: the first ``length`` bytes at each window of the open runs."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a bounded number of windows at a time
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = part.column("bytes").to_pylist()
                views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), length) for t in texts]
                count = np.array([len(v) for v in views], np.int64)
                index = pa.array(np.repeat(np.arange(len(texts)), count))
                at = np.concatenate([lo + np.arange(n) for lo, n in zip(part.column("lo").to_numpy(), count, strict=True)])
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(at), [None, pa.py_buffer(b"".join(v.tobytes() for v in views))])
                yield pa.RecordBatch.from_arrays([strings.cast(pa.binary()), part.column("doc_id").take(index), part.column("tag").take(index), pa.array(at)], ["suffix", *KEY, "at"])

    return found.select(*KEY, "lo", "bytes").mapInArrow(cut, f"suffix binary, doc_id {kind}, tag long, at long")


def repeated_suffixes(found: DataFrame) -> DataFrame:
    """``(doc_id, tag, at)``: suffixes with a longest previous factor of their whole length."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["suffix", *KEY, "at"]
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = found.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        names = [*order, "part", "edge"]
        task, before, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not len(batch):
                continue
            suffix = batch.column("suffix")
            shifted = pa.concat_arrays([pa.array([before], suffix.type), suffix.slice(0, len(suffix) - 1)])
            agrees = pc.fill_null(pc.equal(suffix, shifted), False)
            hits = batch.filter(agrees)
            none = pa.nulls(len(hits), suffix.type)
            yield pa.RecordBatch.from_arrays([none, *hits.columns[1:], pa.array(np.full(len(hits), task, np.int32)), pa.array([None] * len(hits), pa.string())], names)
            if last is None:
                yield pa.RecordBatch.from_arrays([*batch.slice(0, 1).columns, pa.array([task], pa.int32()), pa.array(["first"])], names)
            before, last = suffix[-1].as_py(), batch.slice(len(batch) - 1, 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([task], pa.int32()), pa.array(["last"])], names)

    compared = staged(ordered.mapInArrow(compare, f"suffix binary, doc_id {kind}, tag long, at long, part int, edge string"))
    # two rows per partition
    edges = sorted(compared.where("edge is not null").collect(), key=lambda r: (r["part"], r["edge"] == "last"))
    met, before = [], None
    for row in edges:
        if row["edge"] == "first" and before is not None and row["suffix"] == before:
            met.append((row["doc_id"], row["tag"], row["at"]))
        before = row["suffix"]
    hits = compared.where("edge is null").select(*KEY, "at")
    return hits.union(spark.createDataFrame(met, hits.schema)) if met else hits


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, its bytes."""
    texts = documents(docs)
    judged = staged(judge_runs(texts, length))
    found = staged(open_runs(texts, judged, length))
    grouped = repeated_in_groups(found.where(F.col("kinds") <= GROUP), length)
    spread = repeated_when_spread(found.where(F.col("kinds") > GROUP), length)
    whole = judged.where("state = 'repeated'").select(*KEY, F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    cover = whole.union(grouped).union(spread).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    cover = cover.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "cover")
    rows = packed(texts).join(cover, _same(), "left").select("doc_id", "text", "cover")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "text", PIECE // 4):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for i, held in enumerate(part.column("text").to_pylist()):
                    text = unpack.decompress(held)
                    kept, removed, spans, at = [], 0, 0, 0
                    cover = part.column("cover")[i]
                    if cover.is_valid:
                        a, b = cover.values.field("a").to_numpy(), cover.values.field("b").to_numpy()
                        by = np.argsort(a, kind="stable")
                        a, reach = a[by], np.maximum.accumulate(b[by])
                        new = np.append(True, a[1:] > reach[:-1])
                        for x, y in zip(a[new], reach[np.append(new[1:], True)], strict=True):
                            kept.append(text[at:x])
                            removed, spans, at = removed + int(y - x), spans + 1, int(y)
                    kept.append(text[at:])
                    rest = b"".join(kept)
                    for name, v in zip(out, (len(text), removed, spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        out[name].append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                    ["doc_id", *out],
                )

    return rows.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
