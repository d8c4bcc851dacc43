"""Approximate nearest neighbours from shifted Hilbert curves.

Each curve projects the vectors to a few random orthogonal directions, shifts them at random,
cuts each direction into cells and orders the cells along a Hilbert curve.  Spark sorts all rows
of all curves by range partitioning; a row's rank in its curve comes from the sizes of the
partitions before it.  A query is compared with all rows at most ``width`` ranks away in any
curve: runs of ``BLOCK`` ranks and the queries whose window touches them meet in one task, which
keeps the nearest, and the windows of all curves are merged by exact distance.

``width`` is fitted, not fixed: the true neighbours of a bounded sample of queries are found by
comparing them with every row, and the width is the smallest that would have caught the share
``recall`` of them.  Where vectors have few real dimensions it is small; where they fill all
dimensions evenly, as random vectors do, no ordering keeps neighbours together and the window
becomes a large part of the table.

Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all that a top ``k``
can use, so a very common vector is one row.  Defined cases: vectors that are null, zero, hold a
null or non-finite component, or have another length than most vectors (the longest on ties) take
no part; rows without an id neither; an id on several rows counts with each of its vectors, its
nearest one decides; a table with fewer rows gives all of them; an empty one gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import small, staged

K = 10
CURVES = 8
DIRECTIONS = 4
BITS = 8
SEED = 5
RECALL = 0.97
PILOT = 64
BLOCK = 4096
LANE_QUERIES = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of cells along the Hilbert curve; ``cells`` has a row per point."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the reflections and rotations of each level, from the coarsest to the finest
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``(row, ids, vec)``: each valid vector once, with its ``keep`` smallest ids; ``row`` is the
    smallest of them.  ``rows`` has ``(id, vec)``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = rows.where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    )
    lengths = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    valid = valid.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))
    # equal components in another form (-0.0) are the same vector
    same = valid.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    # the rank limit drops all but the first rows of a vector before the shuffle
    first = Window.partitionBy("vec").orderBy("id")
    return (
        same.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep)
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("row"), "ids", "vec")
    )


def curve_keys(vectors: DataFrame, curves: int, seed: int) -> DataFrame:
    """``(curve, key, row, vec)``: every vector once for each curve.

    A direction's cells span four standard deviations around zero, taken from the mean square of
    the components, so that the cells fit the data at every scale.
    """
    spread = vectors.select(F.avg(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size("vec")).alias("s")).head()["s"]
    scale = float(spread or 1.0) ** 0.5 or 1.0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for c in range(curves if len(x) else 0):
                rng = np.random.default_rng([seed, c])
                d = min(DIRECTIONS, x.shape[1])
                directions = np.linalg.qr(rng.normal(size=(x.shape[1], d)))[0]
                place = (x @ directions / scale + rng.uniform(-0.5, 0.5, d)) / 8 + 0.5
                cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(cells, BITS)), batch.column("row"), batch.column("vec")],
                    ["curve", "key", "row", "vec"],
                )

    schema = f"curve int, key long, row long, vec {vectors.schema['vec'].dataType.simpleString()}"
    return vectors.select("row", "vec").mapInArrow(keys, schema)


def ranked(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``rank``, the place of each row in its curve, counted from 0.

    One range sort of all curves; the place is the row's place in its partition plus the rows of
    its curve in earlier partitions, of which there is one number per partition and curve.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row")
    placed = staged(placed.select("*", F.spark_partition_id().alias("part")))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("curve", "part").orderBy("key", "row")
    return placed.withColumn("_at", F.row_number().over(inside) - 1).join(small(offsets), ["curve", "part"]).withColumn(
        "rank", F.col("_at") + F.col("before")
    ).drop("_at", "before", "part", "key")


def nearest_in_blocks(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """``(query, row)``: the nearest ``k`` rows of a few given queries, by comparing every row."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for q, d in enumerate(_distances(queries, _matrix(batch.column("vec")))):
                d = np.concatenate([held[q][0], np.where(ids == query_ids[q], np.inf, d)])
                i = np.concatenate([held[q][1], ids])
                near = np.argsort(d, kind="stable")[:k]
                held[q] = d[near], i[near]
        for q, (d, i) in enumerate(held):
            yield pa.RecordBatch.from_pydict({"query": np.full(len(i), query_ids[q]), "row": i, "d": d})

    found = rows.select("row", "vec").mapInArrow(best, "query long, row long, d double")
    first = Window.partitionBy("query").orderBy("d", "row")
    return found.where("d < double('infinity')").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).select("query", "row")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_width(vectors: DataFrame, queries: DataFrame, places: DataFrame, k: int, recall: float) -> int:
    """The smallest window that catches ``recall`` of the neighbours of ``PILOT`` queries."""
    pilot = queries.orderBy(F.xxhash64("row"), "row").limit(PILOT).select("row", "vec").collect()
    if not pilot:
        return 1
    asked, asked_rows = np.array([r["vec"] for r in pilot], float), np.array([r["row"] for r in pilot])
    truth = staged(nearest_in_blocks(vectors, asked, asked_rows, k))
    at = places.select("curve", "row", "rank")
    mine = at.join(F.broadcast(truth.select(F.col("query").alias("row")).distinct()), "row")
    theirs = at.join(F.broadcast(truth), "row").withColumnsRenamed({"row": "found", "rank": "there"})
    gaps = theirs.join(mine.withColumnRenamed("row", "query"), ["curve", "query"]).groupBy("query", "found").agg(
        F.min(F.abs(F.col("rank") - F.col("there"))).alias("gap")
    )
    return int(gaps.select(F.percentile("gap", F.lit(recall))).head()[0] or 0) + 1


def search(
    table: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    is_query: str = "id % 100 = 0",
    k: int = K,
    curves: int = CURVES,
    recall: float = RECALL,
    seed: int = SEED,
    width: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its ``k`` nearest found.

    ``is_query`` is a condition on ``id``.  Scores are Euclidean distances in double precision.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    vectors = staged(distinct_vectors(rows, k + 1))
    # every query row asks, also one that is not among the smallest ids of its vector
    asking = rows.where(is_query).withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    asking = asking.join(vectors.select("vec", "row"), "vec").select("row", F.col("id").alias("query_id")).distinct()
    asking = staged(asking)
    places = staged(ranked(curve_keys(vectors, curves, seed)))
    if width is None:
        query_rows = vectors.join(asking.select("row").distinct(), "row", "left_semi")
        width = fit_width(vectors, query_rows, places, k, recall)
    # a task gets one block and a bounded number of queries; more queries meet copies of the block
    n_rows, n_asked = max(1, vectors.count()), asking.select("row").distinct().count()
    lanes = 1 + int(n_asked * min(1.0, (2 * width + BLOCK) / n_rows)) // LANE_QUERIES
    lane_list = F.sequence(F.lit(0), F.lit(lanes - 1))
    members = places.withColumn("block", F.expr(f"rank div {BLOCK}")).withColumn("lane", F.explode(lane_list))
    first, last = F.expr(f"greatest(rank - {width}, 0) div {BLOCK}"), F.expr(f"(rank + {width}) div {BLOCK}")
    probes = (
        places.join(asking.select("row").distinct(), "row", "left_semi")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int"))
    )

    def rerank(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            base, base_rank, base_row = np.stack(right["vec"].to_numpy()).astype(float), right["rank"].to_numpy(), right["row"].to_numpy()
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                asked = np.stack(part["vec"].to_numpy()).astype(float)
                d = _distances(asked, base)
                d[np.abs(part["rank"].to_numpy()[:, None] - base_rank[None]) > width] = np.inf
                # a few more than k, since the last digits decide only after exact distances
                near = np.argsort(d, axis=1, kind="stable")[:, : 2 * k + 2]
                for i, (q, js) in enumerate(zip(part["row"], near, strict=True)):
                    js = js[np.isfinite(d[i, js])]
                    exact = np.sqrt(((base[js] - asked[i]) ** 2).sum(1))
                    out.append(pd.DataFrame({"asked": q, "row": base_row[js], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "row": [], "score": []})

    columns = [F.col(c).alias(c) for c in ("curve", "block", "lane", "row", "rank", "vec")]
    found = probes.select(*columns).groupBy("curve", "block", "lane").cogroup(
        members.select(*columns).groupBy("curve", "block", "lane")
    ).applyInPandas(rerank, "asked long, row long, score double")
    ids = vectors.select("row", "ids")
    each = found.groupBy("asked", "row").agg(F.min("score").alias("score"))
    near = Window.partitionBy("asked").orderBy("score", "row")
    each = each.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1)
    pairs = each.join(ids, "row").select("asked", "score", F.explode("ids").alias("vec_id"))
    pairs = pairs.join(asking.withColumnRenamed("row", "asked"), "asked").where("vec_id != query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
