"""Ranked lexical search: MaxScore with bounds for pairs of terms.

The score of a document is a sum over the item's terms (repeats included) of ``weight * impact``;
an impact depends on the term's occurrences and the document's length alone.

``build_index`` cuts the documents into shards, one row each: documents, and for every term of the
items a list of places and impacts and the greatest impact.  For pairs of terms it intersects the
two lists and stores the greatest joint impact, ``max(weight * impact + weight * impact)``, of a
document that holds both.  A pair's bound, the greatest of its two single maxima and its joint
maximum, is at most the sum of the single maxima, because a short document rarely has the most
of both.  The pairs are those of neighbours in an item's terms ordered by weight, so the terms
of an item are covered by disjoint pairs.

``search`` takes the terms of an item by rising maximum.  Terms whose combined bound (pair bounds
for pairs within, single maxima for the rest) stays below the score of the item's current last hit
cannot lift a document into the hits alone: only the other lists propose documents.  Proposed
documents then meet the remaining lists from the highest maximum down, and drop out as soon as
their score and the combined bound of what is left stay below.  All work on a shard's lists is
array work in Spark tasks; each task keeps the hits of its shards, and one ranking per item over
those of all tasks, in two steps, gives the result.

Items are taken in blocks of bounded numbers of terms, each against all rows; the terms of a
block, its document frequencies and weights are all that is sent to the tasks.

Defined cases: a null or empty text has no terms and is never found; such documents don't count in
the number of documents; rows that repeat an item id are one item with the terms of all its texts;
an item without terms, or whose terms occur nowhere, has no rows; a null document id comes first
among equal scores, rows that repeat a document id are documents of their own and in one order
with the others, an item may have a null id; empty tables give no rows; texts are read whole,
however long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import slices, staged

TOP = 20
# documents of a shard and entries that end one, terms (repeats included) of a block of items,
# ways of the first ranking
SHARD_DOCS = 4096
SHARD_ENTRIES = 1 << 20
BLOCK_TERMS = 1 << 18
LANES = 64

# ASCII characters that are not letters or digits separate terms
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_SHARD = "docs array<bigint>, lengths array<bigint>, starts array<bigint>, places array<int>, counts array<bigint>"
_INDEX = "docs array<bigint>, starts array<bigint>, places array<int>, impacts array<bigint>, most array<bigint>, joint array<bigint>"


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8, only ``A`` to ``Z`` in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_APART).lower().split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence list contributes per unit of weight."""
    m = 75 + 25 * lengths * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


@dataclass
class Items:
    """A block of items: their terms as numbers of one sorted vocabulary, with repeats."""

    ids: list
    vocabulary: dict[bytes, int]
    asked: list[list[tuple[int, int]]]  # per item (term, times)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    pair_at: dict[tuple[int, int], int] = field(default_factory=dict)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Set weights and, from their order within each item, the pairs."""
        self.weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        found = set()
        for item in self.asked:
            order = sorted((t for t, _ in item), key=lambda t: (self.weights[t], t))
            found.update(zip(order[::2], order[1::2]))
        self.pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.pair_at = {(int(a), int(b)): i for i, (a, b) in enumerate(self.pairs)}


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Items]:
    """The items in blocks; one block is in the driver's memory at a time."""

    def block(rows: list[tuple[object, Counter]]) -> Items:
        names = sorted(set().union(*(c for _, c in rows)))
        at = {t: i for i, t in enumerate(names)}
        return Items([i for i, _ in rows], at, [sorted((at[t], n) for t, n in c.items()) for _, c in rows])

    held, size, last = [], 0, None
    ordered = items.select("item_id", "text").where("text is not null").orderBy("item_id")
    for row in ordered.toLocalIterator():
        found = terms(row["text"])
        if held and row["item_id"] == last:
            held[-1][1].update(found)
        else:
            if size + len(found) > block_terms and held:
                yield block(held)
                held, size = [], 0
            held.append((row["item_id"], Counter(found)))
        size, last = size + len(found), row["item_id"]
    if held:
        yield block(held)


def _lists(rows: list[list[tuple[int, int]]], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a shard's documents, term after term: list starts, places, counts."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
    places = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(flat[:, 0], kind="stable")
    starts = np.searchsorted(flat[order, 0], np.arange(n_terms + 1))
    return starts, places[order], flat[order, 1]


def scan(docs: DataFrame, asked: Items, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Occurrence lists of the items' terms, one row per shard; documents without terms are left out."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(asked.vocabulary))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(packed.value)
        ids, lengths, rows, entries = [], [], [], 0

        def shard() -> pa.RecordBatch:
            starts, places, counts = _lists(rows, len(known))
            return pa.RecordBatch.from_pydict({
                "docs": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "starts": pa.array([starts], pa.list_(pa.int64())), "places": pa.array([places], pa.list_(pa.int32())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
            })

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = terms(text)
                    if not found:
                        continue
                    ids.append(doc)
                    lengths.append(len(found))
                    held = Counter(found)
                    rows.append([(known[t], n) for t, n in held.items() if t in known])
                    entries += len(rows[-1])
                    if len(ids) == shard_docs or entries >= SHARD_ENTRIES:
                        yield shard()
                        ids, lengths, rows, entries = [], [], [], 0
        if ids:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where("text is not null").mapInArrow(lists, _SHARD)


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def build_index(shards: DataFrame, asked: Items, n_docs: int, n_terms: int) -> DataFrame:
    """Impacts, the greatest one per term, and the greatest joint one per pair, shard by shard."""
    packed = shards.sparkSession.sparkContext.broadcast(pickle.dumps((asked.weights, asked.pairs)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = pickle.loads(packed.value)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, starts, places, counts = (_numbers(batch, c, i) for c in ("lengths", "starts", "places", "counts"))
                impact = impacts(counts, lengths[places], n_docs, n_terms)
                most = np.zeros(len(weights), np.int64)
                held = np.flatnonzero(np.diff(starts))
                if len(held):
                    most[held] = np.maximum.reduceat(impact, starts[held])
                joint = np.zeros(len(pairs), np.int64)
                values = np.zeros(len(lengths), np.int64)
                before = -1
                for k, (a, b) in enumerate(pairs):
                    if a != before:
                        values[:] = 0
                        values[places[starts[a] : starts[a + 1]]] = impact[starts[a] : starts[a + 1]]
                        before = a
                    there = values[places[starts[b] : starts[b + 1]]]
                    both = there > 0
                    if both.any():
                        sums = weights[a] * there[both] + weights[b] * impact[starts[b] : starts[b + 1]][both]
                        joint[k] = sums.max()
                yield pa.RecordBatch.from_pydict({
                    "docs": batch.column("docs").slice(i, 1), "starts": batch.column("starts").slice(i, 1),
                    "places": batch.column("places").slice(i, 1), "impacts": pa.array([impact], pa.list_(pa.int64())),
                    "most": pa.array([most], pa.list_(pa.int64())), "joint": pa.array([joint], pa.list_(pa.int64())),
                })

    return shards.mapInArrow(index, _INDEX)


def bounds(order: list[tuple[int, int]], single: list[int], joint: dict[tuple[int, int], int]) -> list[int]:
    """What the first ``k`` terms can add together, for every ``k``; ``order`` holds (term, times).

    ``joint`` has the pairs' joint maxima (times 1 each), 0 if no document holds both.
    """
    out, total, met = [0], 0, {}
    partner = {a: b for a, b in joint} | {b: a for a, b in joint}
    for (t, times), most in zip(order, single, strict=True):
        other = partner.get(t)
        if other in met:
            n, ub = met[other]
            both = joint[(t, other) if (t, other) in joint else (other, t)]
            least = min(n, times)
            # a document with both: `least` times the pair, and the rest of the more frequent term
            together = least * both + (n - least) * (ub // n) + (times - least) * (most // times) if both else 0
            total += max(ub, most, min(together, ub + most)) - ub
        else:
            total += most
        met[t] = (times, most)
        out.append(total)
    return out


class Hits:
    """The best documents of one item so far."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def least(self) -> int:
        """A document needs at least this score; equal scores are ranked by id."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, docs: list, scores: np.ndarray) -> None:
        new = zip(scores.tolist(), docs, strict=True)
        self.rows = sorted([*self.rows, *new], key=lambda r: (-r[0], r[1] is not None, r[1] or 0))[: self.top]


def search_shard(item: list[tuple[int, int]], asked: Items, shard: dict[str, np.ndarray], docs: pa.Array, hits: Hits) -> int:
    """Add the shard's best documents; returns how many documents were scored."""
    starts, places, impact, most = shard["starts"], shard["places"], shard["impacts"], shard["most"]
    ub = {t: int(n * asked.weights[t] * most[t]) for t, n in item}
    order = sorted(((t, n) for t, n in item if ub[t]), key=lambda x: (ub[x[0]], x[0]))
    if not order:
        return 0
    by_weight = sorted((t for t, _ in item), key=lambda t: (asked.weights[t], t))
    joint = {p: int(shard["joint"][asked.pair_at[p]]) for p in zip(by_weight[::2], by_weight[1::2]) if ub[p[0]] and ub[p[1]]}
    bound = bounds(order, [ub[t] for t, _ in order], joint)
    if bound[-1] < hits.least:
        return 0
    # the first lists whose bound stays below propose nothing
    first = max(k for k in range(len(order)) if bound[k] < hits.least)
    scores = np.zeros(len(docs), np.int64)
    for t, n in order[first:]:
        at = slice(starts[t], starts[t + 1])
        scores[places[at]] += n * asked.weights[t] * impact[at]
    found = np.flatnonzero(scores)
    value = scores[found]
    seen = len(found)
    for k in range(first - 1, -1, -1):
        keep = value + bound[k + 1] >= hits.least
        found, value = found[keep], value[keep]
        if not len(found):
            return seen
        t, n = order[k]
        own = places[starts[t] : starts[t + 1]]
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        value = value + np.where(own[at] == found, n * asked.weights[t] * impact[starts[t] + at], 0)
    keep = value >= hits.least
    found, value = found[keep], value[keep]
    if len(found) > hits.top:
        # ties with the last one stay
        edge = np.partition(value, len(value) - hits.top)[len(value) - hits.top]
        found, value = found[value >= edge], value[value >= edge]
    hits.add(docs.take(pa.array(found)).to_pylist(), value)
    return seen


def search_index(index: DataFrame, asked: Items, top: int = TOP) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each task's shards, items by their numbers."""
    packed = index.sparkSession.sparkContext.broadcast(pickle.dumps(asked))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pickle.loads(packed.value)
        hits = [Hits(top) for _ in block.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: _numbers(batch, c, i) for c in ("starts", "places", "impacts", "most", "joint")}
                docs = batch.column("docs")[i].values
                for item, found in zip(block.asked, hits, strict=True):
                    search_shard(item, block, shard, docs, found)
        rows = [(i, doc, score) for i, h in enumerate(hits) for score, doc in h.rows]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return index.mapInArrow(best, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = None
    for asked in item_blocks(items, block_terms):
        shards = staged(scan(docs, asked, shard_docs))
        totals = shards.agg(F.sum(F.size("docs")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, n: x + n))).head()
        lists = shards.select(F.posexplode(F.expr("transform(sequence(1, size(starts) - 1), i -> starts[i] - starts[i - 1])")).alias("t", "n"))
        df = np.zeros(len(asked.vocabulary), np.int64)
        # one number per term of the block
        for row in lists.where("n > 0").groupBy("t").agg(F.sum("n").alias("n")).collect():
            df[row["t"]] = row["n"]
        n_docs, n_terms = totals[0] or 0, totals[1] or 0
        asked.weigh(n_docs, df)
        index = staged(build_index(shards, asked, n_docs, n_terms))
        found = search_index(index, asked, top)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
        lane = F.pmod(F.xxhash64("doc_id", "score"), F.lit(LANES))
        some = found.withColumn("_lane", lane).withColumn("_n", F.row_number().over(Window.partitionBy("item", "_lane").orderBy(*order))).where(F.col("_n") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(asked.ids)), f"item int, item_id {kind.simpleString()}")
        # at most one row per item of the block
        rows = staged(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
