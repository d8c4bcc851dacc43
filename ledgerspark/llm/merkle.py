"""A Merkle manifest of a table: one tree per source, one tree over the sources, a proof per row.

A leaf is the SHA-256 of a row's fields.  The leaves of a source ascend by id; every ``FANOUT``
consecutive nodes become the SHA-256 of their hex digests until one is left, the subroot.  Subroots
ordered by source (null first, then bytewise) become the root in the same way.

Digests go up and proofs go down by time-forward processing.  A node's label is ``(last leaf below
it, level)``, so children come before their parents.  ``sweep_up`` takes the labels in ascending
order from a priority queue that hands every parent the digests of its children; ``sweep_down``
takes them in descending order from a queue that hands every child the part of the proof above it
(the proof's suffix).  A sweep covers ``LEVELS`` levels of one block of leaves; its queue never
holds more than ``FANOUT`` messages per level.  Between blocks the queue is external: messages are
tables in the shared folder, keyed by the receiver's tree and place and put in label order by
Spark's sorts, which spill.  A tree of 10^11 leaves takes three such tables each way, and a source
with a large share of all rows is spread over tasks block by block.

A proof is a list of ``(before, after)``, one per level from the leaf to the root: the digests of
the run that stand before and after the node's own, concatenated.  ``folded`` computes a root from
a leaf and a proof with built-in functions.

Defined cases: a null field is ``-``, any other is its number of bytes, ``:`` and its value; a null
id comes first; rows that repeat an id are in the order of their digests (equal rows are
interchangeable); a source with one row has that leaf as subroot; an empty table has no rows;
texts are hashed whole, however long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import small, staged

FANOUT = 16
# levels of a block of FANOUT ** LEVELS leaves, and leaves whose proofs are put out at once
LEVELS = 3
OUT_ROWS = 1024

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = "array<struct<before:string,after:string>>"
_PAIR = pa.struct([("before", pa.string()), ("after", pa.string())])
_NODE = "tree string, pos long, n long, digest string, doc_id long, other string"


# --- digests and proofs as expressions ------------------------------------------------------


def row_digest(values: list[Column]) -> Column:
    """SHA-256 of a row's fields, each with its length in front."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, level by level, left to right."""
    levels = F.transform(proof, lambda p: F.concat(p["before"], p["after"]))
    return F.sha2(F.array_join(levels, "").cast("binary"), 256)


# --- sweeps over one block ------------------------------------------------------------------


def n_levels(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _label(level: int, index: int, n: int, fanout: int) -> tuple[int, int]:
    """Place of a node in the order of processing: the last of the ``n`` leaves below it, level."""
    return min((index + 1) * fanout**level, n) - 1, level


def sweep_up(leaves: list[str], levels: int, fanout: int = FANOUT) -> tuple[str, dict]:
    """The digest on top of a block, and the children's digests of every node of it."""
    n, queue, children = len(leaves), [], {}

    def send(level: int, index: int, digest: str) -> None:
        heapq.heappush(queue, (_label(level + 1, index // fanout, n, fanout), index, digest))

    if not levels:
        return leaves[0], children
    top = leaves[0]
    for place, leaf in enumerate(leaves):
        send(0, place, leaf)
        # every node whose last leaf this is has all its messages now
        while queue and queue[0][0][0] == place:
            label = queue[0][0]
            index, run = queue[0][1] // fanout, []
            while queue and queue[0][0] == label:
                run.append(heapq.heappop(queue)[2])
            children[label[1], index] = run
            top = hashlib.sha256("".join(run).encode()).hexdigest()
            if label[1] < levels:
                send(label[1], index, top)
    return top, children


def sweep_down(n: int, children: dict, levels: int, above: tuple, fanout: int = FANOUT) -> list[tuple]:
    """The proof of every leaf of a block whose top node has the proof ``above``."""
    proofs: list[tuple] = [above] * n
    queue: list = []

    def send(level: int, index: int, proof: tuple) -> None:
        last, level = _label(level, index, n, fanout)
        heapq.heappush(queue, (-last, -level, index, proof))

    if levels:
        send(levels, 0, above)
    while queue:
        _, level, index, proof = heapq.heappop(queue)
        run = children[-level, index]
        for slot, _ in enumerate(run):
            below = (("".join(run[:slot]), "".join(run[slot + 1 :])), *proof)
            if level == -1:
                proofs[index * fanout + slot] = below
            else:
                send(-level - 1, index * fanout + slot, below)
    return proofs


# --- the tables between blocks --------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _groups(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple]:
    """Tree, block number, size of the tree, the message from above (or None) and the nodes."""
    for (tree, number), rows in groupby(_rows(batches), key=lambda r: (r["tree"], r["block"])):
        nodes = list(rows)
        head = nodes.pop(0) if nodes[0]["pos"] < 0 else None
        yield tree, number, nodes[0]["n"] if nodes else 0, head, nodes


def _by_block(nodes: DataFrame, block: int) -> DataFrame:
    return (
        nodes.withColumn("block", F.col("block") if "block" in nodes.columns else F.floor(F.col("pos") / block))
        .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    )


def _raise(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One message per block: the digest of its top node, which is a node of the next table."""
    block = fanout**levels

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, number, n, _, rows in _groups(batches, block):
            top, _ = sweep_up([r["digest"] for r in rows], min(levels, n_levels(n, fanout)), fanout)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree], pa.string()), "pos": [number], "n": [-(-n // block)], "digest": [top],
                "doc_id": pa.array([None], pa.int64()), "other": pa.array([None], pa.string()),
            })

    return _by_block(nodes.select("tree", "pos", "n", "digest"), block).mapInArrow(up, _NODE)


def _lower(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of nodes, from those of the top nodes of their blocks (``above``: ``tree, block``)."""
    block = fanout**levels

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, n, head, rows in _groups(batches, block):
            if not rows:
                continue
            high = min(levels, n_levels(n, fanout))
            _, children = sweep_up([r["digest"] for r in rows], high, fanout)
            over = tuple((p["before"], p["after"]) for p in head["proof"])
            proofs = sweep_down(len(rows), children, high, over, fanout)
            for at in range(0, len(rows), OUT_ROWS):
                part, some = rows[at : at + OUT_ROWS], proofs[at : at + OUT_ROWS]
                lists = [[{"before": b, "after": a} for b, a in p] for p in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(part), pa.string()), pa.array([r["pos"] for r in part], pa.int64()),
                        pa.array([r["digest"] for r in part], pa.string()), pa.array([r["doc_id"] for r in part], pa.int64()),
                        pa.array([r["other"] for r in part], pa.string()), pa.array([head["subroot"]] * len(part), pa.string()),
                        pa.array(lists, pa.list_(_PAIR)),
                    ],
                    ["tree", "pos", "digest", "doc_id", "other", "subroot", "proof"],
                )

    none = F.lit(None)
    rows = nodes.withColumn("block", F.floor(F.col("pos") / block)).withColumns(
        {"proof": none.cast(PROOF), "subroot": none.cast("string")}
    )
    heads = above.withColumns({
        "pos": F.lit(-1).cast("long"), "n": F.lit(0).cast("long"), "digest": none.cast("string"),
        "doc_id": none.cast("long"), "other": none.cast("string"),
    })
    out = f"tree string, pos long, digest string, doc_id long, other string, subroot string, proof {PROOF}"
    return _by_block(rows.unionByName(heads), block).mapInArrow(down, out)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree`` by ``keys``, and ``n``, the tree's rows.

    A range sort spreads large trees over tasks; a place is that in its part and the tree's rows
    in earlier parts, of which there is one count per part and tree.
    """
    ordered = rows.repartitionByRange("tree", *keys).sortWithinPartitions("tree", *keys)
    placed = staged(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part"), F.col("tree").alias("_tree")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    all_parts = Window.partitionBy("_tree")
    earlier = all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select(
        "_part", "_tree", (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_shift"),
        F.sum("_n").over(all_parts).alias("n"),
    ))
    same = (part == F.col("_part")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return placed.join(small(starts), same).withColumn("pos", F.col("_at") - F.col("_shift")).drop("_at", "_part", "_tree", "_shift")


def _n_tables(n: int, block: int) -> int:
    tables = 1
    while n > block:
        n, tables = -(-n // block), tables + 1
    return tables


class Trees:
    """Trees over numbered nodes ``tree, pos, n, digest, doc_id, other``."""

    def __init__(self, leaves: DataFrame, fanout: int, levels: int):
        self.fanout, self.levels, self.block = fanout, levels, fanout**levels
        self.sent = [leaves.select("tree", "pos", "n", "digest", "doc_id", "other")]
        most = leaves.agg(F.max("n")).head()[0] or 0
        for _ in range(_n_tables(most, self.block)):
            now = self.sent[-1]
            # a tree that is done after the first table sends nothing more
            open_ = now if len(self.sent) == 1 else now.where("n > 1")
            self.sent.append(staged(_raise(open_, fanout, levels)))

    def roots(self) -> DataFrame:
        """``(tree, tables, digest)``: each tree's top digest and how many tables led to it."""
        found = [t.where("n = 1").select("tree", F.lit(i).alias("tables"), "digest") for i, t in enumerate(self.sent) if i]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """Proofs of all leaves; ``above (tree, tables, subroot, proof)`` are those of the roots."""
        heads = None
        for i in range(len(self.sent) - 2, -1, -1):
            now = self.sent[i] if i == 0 else self.sent[i].where("n > 1")
            tops = above.where(F.col("tables") == i + 1).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "proof")
            if heads is not None:
                tops = tops.unionByName(heads.select("tree", F.col("pos").alias("block"), "subroot", "proof"))
            heads = _lower(now, tops, self.fanout, self.levels)
            if i:
                heads = staged(heads)
        return heads


def leaves_of(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """``(tree, doc_id, digest, other)`` of every row; ``other`` is a second text for the row.

    ``other`` holds the digest of the row with that text where it is not null, else the row's own.
    """
    fields = [F.col(c) for c in FIELDS]
    own = row_digest(fields)
    second = own if other is None else F.when(other.isNull(), own).otherwise(row_digest([*fields[:-1], other]))
    return docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        own.alias("digest"), second.alias("other"),
    )


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``(source, doc_id, leaf, other, subroot, root, proof)`` of every leaf of ``leaves_of``."""
    # equal rows must not meet in one part of the range sort
    tied = staged(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    trees = Trees(staged(numbered(tied, ["doc_id", "digest", "_tie"])), fanout, levels)
    roots = staged(trees.roots())
    none = F.lit(None)
    tops = roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("source"), "tables", "digest",
        none.cast("long").alias("doc_id"),
    )
    # the tree over the sources; a subroot's source travels in ``other``
    over = Trees(staged(numbered(tops, ["source"]).withColumn("other", F.col("source"))), fanout, levels)
    top = over.roots().select("tree", "tables", F.col("digest").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    above = staged(over.proofs(top).select(F.col("other").alias("tree"), F.col("subroot").alias("root"), F.col("digest").alias("subroot"), "proof"))
    # the root is the same in all rows
    root = above.agg(F.min("root")).head()[0]
    same = F.col("tree").eqNullSafe(F.col("_tree"))
    heads = above.drop("root").join(roots.select(F.col("tree").alias("_tree"), "tables"), same).drop("_tree")
    return trees.proofs(heads).select(
        F.col("tree").alias("source"), "doc_id", F.col("digest").alias("leaf"), "other", "subroot",
        F.lit(root).cast("string").alias("root"), "proof",
    )


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest's digests per document, and the check of rows that lost their capitals.

    Rows whose id's crc32 is divisible by 5 are checked with ``A`` to ``Z`` of their text in lower
    case, all others as they are; a row without such letters still verifies.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(picked, F.translate(F.col("text"), upper, upper.lower()))
    return manifest(leaves_of(docs.select(*FIELDS), changed)).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("other"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
