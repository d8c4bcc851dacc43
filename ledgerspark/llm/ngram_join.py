"""Near-duplicate join on word shingles, and the components of its links.

Two documents link when ``100 * |x & y| >= 80 * |x | y|`` of their sets of distinct 5-word
shingles (64-bit hashes of lower-cased words).  Documents with equal sets are one unit.  Every
step leaves out only pairs that cannot link:

1. **Sieve.**  In one fixed order of all shingles, units that link share at least ``share(n)`` of
   the first ``n - ceil(0.8 n) + share(n)`` shingles of each.  Only these prefixes are shuffled;
   a unit with fewer shared ones than its smallest partner would need is done.
2. **Rare first.**  For what is left, shingles are counted and ordered from rare to frequent.  A
   unit needs 80 % shared shingles, and a pair meets in the rarest 20 % of both; the ranks of the
   shingle where it meets bound its overlap.  Widely shared passages come last in this order.
3. **Leaders.**  Each prefix list first offers one unit, that of earliest rank, to all others: one
   candidate per posting.  A large group of near copies becomes one component here without its
   pairs.
4. **The rest.**  Only lists that still hold several components offer the pairs across them that
   the rank bound allows, so the links of one component are never listed in full.

Candidates are decided by T-occurrence search: the shingles of one unit, as queries on inverted
lists of its candidates, must meet a candidate often enough.  DivideSkip merges the short lists
on a heap for what they must contribute and probes the longest lists by binary search.

Defined cases: a null or empty text, or one of separators only, has the empty set, links with
nothing and is its own component; equal sets of repeated rows or ids are one unit; a null id has
its component, named by the smallest id in it if there is one; an empty table gives no rows; only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import BATCH_BYTES, slices, small, staged
from ledgerspark.llm.components import components
from ledgerspark.operators.skew import salted_join

WORDS = 5
PERCENT = 80
SIEVE = 8  # a prefix must share one in so many of all shingles
CHUNK = 64  # candidates that one search holds
PAIRS_PER_TASK_GROUP = 512
HOT_COPIES = 1000  # rows of one text that are spread over tasks when they get their names
MU = 0.0085  # cost ratio of DivideSkip's choice of long lists

_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(21).integers(1, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of a text in lower case."""
    b = np.frombuffer(text, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    powers = np.cumprod(np.full(int((ends - starts).max()), _BASE), dtype=np.uint64)
    place = np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(b)]])))
    values = np.where(blank, np.uint64(0), _TABLE[b] * powers[np.minimum(place, len(powers) - 1)])
    return _mixed(np.add.reduceat(values, starts)), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, at = word_hashes(b"\n".join(texts).lower())
    cuts = np.searchsorted(at, np.append(0, ends))
    found = []
    for a, b in itertools.pairwise(cuts):
        w = words[a:b]
        if len(w) >= WORDS:
            n = len(w) - WORDS + 1
            s = sum((w[i : i + n] * _MIX[i] for i in range(1, WORDS)), w[:n] * _MIX[0])
        elif len(w):
            # a short text is one shingle, which also tells its number of words
            s = (w * _MIX[: len(w)]).sum(keepdims=True) + _MIX[WORDS:] * np.uint64(len(w))
        else:
            s = w
        found.append(np.unique(_mixed(s).view(np.int64)))
    return found


def need(n: int) -> int:
    """The smallest overlap of a set of ``n`` shingles with any set that it links to."""
    return -(-PERCENT * n // 100)


def share(n: int) -> int:
    """Shared prefix shingles that the sieve asks for; grows with ``n``."""
    return max(1, n // SIEVE)


def _unit(grams: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def documents_with_prefixes(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, unit, n, prefix)`` per row.

    ``tag`` is crc32 of the text, ``unit`` a digest of the set and null if that is empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                sets = shingle_sets(texts)
                prefixes = [s[: max(0, len(s) - need(len(s)) + share(len(s)))] if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([_unit(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()), _lists(prefixes),
                    ],
                    ["doc_id", "tag", "unit", "n", "prefix"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(read, f"doc_id {kind}, tag long, unit long, n long, prefix array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """``(unit, n, grams)`` per row with a non-empty set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets = [s for s in shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_unit(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["unit", "n", "grams"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(read, "unit long, n long, grams array<long>")


def _need(n: str) -> str:
    return f"(({PERCENT} * {n} + 99) div 100)"


def sieve(rows: DataFrame) -> DataFrame:
    """``(doc_id, unit)``: one document of each unit that may link to another unit."""
    copies = rows.where("unit is not null").groupBy("unit").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copies = copies.where("_n > 1").select(F.col("unit").alias("_unit"), "_first")
    one = rows.where("unit is not null").join(small(copies), F.col("unit") == F.col("_unit"), "left")
    one = one.where(F.col("_unit").isNull() | F.col("doc_id").eqNullSafe(F.col("_first")))
    tokens = one.select("doc_id", "unit", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("token").alias("_token"))
    met = tokens.join(shared, F.col("token") == F.col("_token"), "left_semi").groupBy("doc_id", "unit", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.where(f"met >= greatest(1, {_need('n')} div {SIEVE})").select("doc_id", "unit")


def rare_first(sets: DataFrame) -> DataFrame:
    """``(token, unit, n, i)``: the rarest shingles of each unit, with their ranks ``i`` from 0.

    Shingles of one unit only come first and are not listed; a unit with too few others is left
    out.
    """
    tokens = sets.select("unit", "n", F.explode("grams").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("token").alias("_token"), "df")
    known = tokens.join(counts, F.col("token") == F.col("_token")).select("unit", "n", "token", "df")
    own = Window.partitionBy("unit")
    ranked = known.withColumn("_shared", F.count(F.lit(1)).over(own)).withColumn("_r", F.row_number().over(own.orderBy("df", "token")))
    i = F.col("n") - F.col("_shared") + F.col("_r") - 1
    return ranked.where(f"_shared >= {_need('n')}").withColumn("i", i).where(f"i <= n - {_need('n')}").select("token", "unit", "n", "i")


#: Whether the ranks where two units meet leave room for the overlap that they need.
_ROOM = "9 * least(n - i, n2 - i2) >= 4 * (n + n2)"
_APART = f"100 * least(n, n2) >= {PERCENT} * greatest(n, n2)"


def leader_pairs(postings: DataFrame) -> DataFrame:
    """``(query, unit)``: a leader of each list with every other unit of it.

    The leader is the unit with the earliest rank: it has the fewest rarer shingles, as the text
    that near copies were made from does, which each of its copies links to.
    """
    first = F.min(F.struct("i", "unit", "n")).alias("f")
    leaders = postings.groupBy(F.col("token").alias("_token")).agg(first, F.count(F.lit(1)).alias("_c")).where("_c > 1")
    leaders = leaders.select("_token", F.col("f.unit").alias("query"), F.col("f.n").alias("n2"), F.col("f.i").alias("i2"))
    met = postings.join(leaders, F.col("token") == F.col("_token")).where("unit != query").where(_ROOM).where(_APART)
    return met.select("query", "unit").distinct()


def cross_pairs(postings: DataFrame, found: DataFrame) -> DataFrame:
    """``(query, unit)``: pairs of a list in different components, with room to link.

    ``found`` has the components so far.  In each list the component of the leader is at home; only what is not at home asks.  Of a pair with room, one has the meeting shingle in its
    first ninth, so that lists of later ranks only, as common passages make, offer nothing.
    """
    of = found.select(F.col("node").alias("_node"), "component")
    known = postings.join(of, F.col("unit") == F.col("_node"), "left").withColumn("c", F.coalesce("component", "unit")).drop("_node", "component")
    lists = known.groupBy(F.col("token").alias("_token")).agg(F.min(F.struct("i", "unit", "c")).alias("f"), F.min("c").alias("_a"), F.max("c").alias("_b"))
    lists = lists.where("_a != _b").select("_token", F.col("f.c").alias("home"))
    mixed = staged(known.join(lists, F.col("token") == F.col("_token")).drop("_token"))
    asks = mixed.where("c != home").select(F.col("token").alias("_token"), F.col("unit").alias("query"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("c").alias("c2"))
    early, early2 = "9 * i <= n", "9 * i2 <= n2"
    on = F.col("token") == F.col("_token")
    one = mixed.where(early).join(asks, on).where("c != c2").where(_ROOM).where(_APART)
    two = mixed.where(f"not ({early})").join(asks.where(early2), on).where("c != c2").where(_ROOM).where(_APART)
    pairs = one.select("query", "unit").union(two.select("query", "unit"))
    return pairs.select(F.least("query", "unit").alias("query"), F.greatest("query", "unit").alias("unit")).distinct()


def t_occurrence(query: np.ndarray, candidates: list[np.ndarray]) -> list[int]:
    """The places of the candidates that link to the query, by DivideSkip."""
    sizes = np.array([len(c) for c in candidates])
    # overlap that 80 % of the union asks for, from both sizes
    wanted = -(-PERCENT * (len(query) + sizes) // (100 + PERCENT))
    tokens, owners = np.concatenate(candidates), np.repeat(np.arange(len(candidates)), sizes)
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    low, high = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    lists = sorted((owners[a:b].tolist() for a, b in zip(low, high, strict=True) if a < b), key=len, reverse=True)
    least = int(wanted.min())
    if len(lists) < least:
        return []
    # long lists are set aside as long as the short ones must still contribute
    n_long = min(least - 1, len(lists), int(least / (MU * math.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    linked = []
    for owner, run in itertools.groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count < wanted[owner] - n_long:
            continue
        for x in long:
            at = bisect_left(x, owner)
            count += at < len(x) and x[at] == owner
        if count >= wanted[owner]:
            linked.append(owner)
    return linked


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: the pairs ``(query, unit)`` that link.

    A query's candidates are cut into chunks, and small groups of chunks share a task call; a
    query with very many candidates is thus spread, and its set is sent once per chunk.
    """
    total = pairs.count()
    groups = max(1, -(-total // PAIRS_PER_TASK_GROUP))
    sizes = pairs.groupBy(F.col("query").alias("_query")).agg(F.count(F.lit(1)).alias("_c"))
    cut = pairs.join(sizes, F.col("query") == F.col("_query")).withColumn("chunk", F.pmod(F.xxhash64("unit"), F.expr(f"1 + _c div {CHUNK}")))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("query", "chunk"), F.lit(groups))).select("g", "query", "chunk", "unit")
    cut = staged(cut)
    grams = sets.select(F.col("unit").alias("_unit"), "grams")
    right = cut.join(grams, F.col("unit") == F.col("_unit")).select("g", "query", "chunk", "unit", "grams")
    asked = cut.select(*(F.col(c).alias(c) for c in ("g", "query", "chunk"))).distinct()
    left = asked.join(grams, F.col("query") == F.col("_unit")).select("g", "query", "chunk", F.col("grams").alias("grams"))

    def search(_key, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        queries = {(q, c): g for q, c, g in zip(asked["query"], asked["chunk"], asked["grams"], strict=True)}
        out: list[tuple[int, int]] = []
        for key, part in offered.groupby(["query", "chunk"], sort=False):
            units = part["unit"].to_numpy()
            hit = t_occurrence(np.asarray(queries[key]), [np.asarray(g) for g in part["grams"]])
            out += [(key[0], int(units[i])) for i in hit]
        return pd.DataFrame(out, columns=["a", "b"])

    # fresh names for columns that both sides have from the same tables
    left, right = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (left, right))
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, tag, n_shingles, component_id, group``.

    ``component_id`` is the smallest id of the component; ``group`` is the component itself, which
    also tells components apart that rows repeating an id give the same name (null if alone
    because the text has no words).
    """
    rows = staged(documents_with_prefixes(docs))
    likely = staged(sieve(rows))
    ids = small(likely.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    units = likely.select(F.col("unit").alias("_unit")).distinct()
    sets = staged(sets_of(texts).join(small(units), F.col("unit") == F.col("_unit"), "left_semi").dropDuplicates(["unit"]))
    postings = staged(rare_first(sets))
    near = staged(links(staged(leader_pairs(postings)), sets))
    rest = links(staged(cross_pairs(postings, components(near))), sets)
    groups = components(staged(near.union(rest)))

    narrow = rows.select("doc_id", "tag", "unit", "n")
    first = narrow.where("unit is not null").groupBy("unit").agg(F.min("doc_id").alias("first"))
    named = groups.join(first, F.col("node") == F.col("unit")).select(F.col("unit").alias("_unit"), "component", "first")
    names = named.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("name"))
    by_unit = named.join(names, F.col("component") == F.col("_c")).select("_unit", "component", "name")
    copied = narrow.where("unit is not null").groupBy(F.col("unit").alias("_copy")).agg(F.min("doc_id").alias("copy_first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    # what is known of a unit, once per unit; rows of one text are spread, and so are those without words
    known = by_unit.join(copied, F.col("_unit") == F.col("_copy"), "full_outer").select(
        F.coalesce("_unit", "_copy").alias("unit"), "component", "name", "copy_first"
    )
    lanes = narrow.withColumn("_lane", F.monotonically_increasing_id())
    out = salted_join(lanes, staged(known), ["unit"], "_lane", hot_rows=HOT_COPIES)
    name = F.coalesce("name", "copy_first", "doc_id").alias("component_id")
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), name, F.coalesce("component", "unit").alias("group"))
