"""Mix sources to target weights with Sainte-Laguë apportionment of equal-token blocks.

Two levels.  The whole mix is a number of blocks of ``block`` tokens; the blocks are allocated to
sources by the highest quotients ``target / (2k + 1)``.  A source is cut into shards by a seeded
hash, as many as the square root of its documents, so that neither a source's list of shards nor
a shard's list of documents grows with more than the root of the input; a source's blocks are
allocated to its shards in the same way, by shard size.  A shard then takes its blocks from the
stream of its documents in seeded order, whole passes first and one last partial pass.

Everything is DataFrame expressions.  Quotas are found without listing the blocks: a divisor
argument brackets each quota within a few units and only those candidates are ranked.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own,
the last one; null ids are mixed like others; rows that repeat an id are mixed on their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import small, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 16
SEED = 11

_BIG = "decimal(38,0)"


def sainte_lague(parts: DataFrame, group: str, weight: str, seats: str, order: str) -> DataFrame:
    """``parts`` with ``quota``: the ``seats`` of each group go to the highest quotients.

    With all ``m`` seats rounded, the divisor that fits gives each part between
    ``w * (seats - m/2) / W - 1/2`` and ``w * (seats + m/2) / W + 1/2`` seats.  Seats below that
    bracket are certain; only the quotients inside it are ranked, a few per part.  Ties go to
    the part that comes first in ``order``.
    """
    w = Window.partitionBy(group)
    m = F.count(F.when(F.col(weight) > 0, 1)).over(w)
    total = F.sum(F.col(weight).cast("double")).over(w)
    known = parts.withColumns({"_m": m, "_total": total})
    share = F.col(weight).cast("double") / F.col("_total")
    low = F.floor(share * (F.col(seats) - F.col("_m") / 2) - 0.5).cast("long") - 1
    known = known.withColumn(
        "_sure", F.when(F.col(weight) > 0, F.greatest(F.lit(0).cast("long"), low)).otherwise(F.lit(0).cast("long"))
    ).withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    width = (F.ceil(share * F.col("_m")) + 4).cast("long")
    tried = known.where((F.col(weight) > 0) & (F.col(seats) > 0)).withColumn(
        "_k", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + width))
    )
    quotient = F.col(weight).cast("double") / (2 * F.col("_k") + 1)
    ranked = Window.partitionBy(group).orderBy(quotient.desc(), F.col(order), F.col("_k"))
    won = (
        tried.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(F.col(group).alias("_g"), F.col(order).alias("_o"))
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    joined = known.join(won, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_o")), "left")
    quota = F.col("_sure") + F.coalesce("_won", F.lit(0))
    return joined.select(*parts.columns, quota.alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: ``rank, source_size, n_docs, target, mix_size``.

    Targets are shares of all words by weight, filled up like water below the caps: ordered by
    cap per weight, the sources before the first one that stays under its cap are capped.
    """
    lcm = 1
    for x in weights:
        lcm *= x
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    one = Window.partitionBy(F.lit(0))
    order = F.array(*[F.lit(int(x)) for x in weights])
    ranked = by_source.withColumn(
        "rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("long")
    ).withColumn("w", F.element_at(order, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
    limit = (F.col("source_size") * cap).cast(_BIG)
    before = one.orderBy((limit * F.expr(f"{lcm} div w").cast(_BIG)), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    filled = ranked.withColumns({
        "cap": limit,
        "all": F.sum("source_size").over(one).cast(_BIG),
        "all_w": F.sum("w").over(one).cast(_BIG),
        "cap_before": F.coalesce(F.sum(limit).over(before), F.lit(0)).cast(_BIG),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)).cast(_BIG),
    })
    rest, rest_w = F.col("all") - F.col("cap_before"), F.col("all_w") - F.col("w_before")
    capped = F.col("cap") * rest_w < F.col("w") * rest
    marked = filled.withColumns({"rest": rest.cast(_BIG), "rest_w": rest_w.cast(_BIG), "capped": capped})
    first = F.min(F.when(~F.col("capped"), F.col("w_before"))).over(one)
    marked = marked.withColumn("_first", first)
    pick = lambda c: F.max(F.when(~F.col("capped") & (F.col("w_before") == F.col("_first")), F.col(c))).over(one)
    level = marked.withColumns({"_rest": pick("rest"), "_rest_w": pick("rest_w")})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("_rest")).cast("double") / F.col("_rest_w").cast("double")
    )
    return level.select(
        "source", "rank", "source_size", "n_docs", target.alias("target"), F.col("all").cast("long").alias("mix_size")
    )


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size)``; size is the number of words, 0 for a null text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _seeded(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` and the plan's ``source``, ``shard``.

    ``sizes`` has ``(doc_id, source, size)`` and is read three times; pass a staged table.
    """
    seats = F.expr(f"(mix_size + {block // 2}) div {block}")
    targets = source_targets(sizes, weights, cap).withColumns({"all": F.lit(0), "seats": seats})
    # a few numbers per source, used for the shards and again for the documents
    quotas = staged(
        sainte_lague(targets, "all", "target", "seats", "rank").select(
            "source", "rank", "source_size", "target",
            F.ceil(F.sqrt("n_docs")).cast("long").alias("shards"), F.col("quota").alias("source_quota"),
        )
    )
    known = small(quotas.withColumnRenamed("source", "_source"))
    hashed = sizes.withColumn("_h", _seeded(F.col("doc_id"), seed)).join(
        known, F.col("source").eqNullSafe(F.col("_source"))
    )
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    placed = hashed.withColumn("shard", F.shiftright(place * F.col("shards"), 32))
    shards = placed.groupBy("rank", "shard").agg(
        F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota")
    )
    shards = sainte_lague(shards, "rank", "shard_size", "source_quota", "shard").select(
        F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * cap).alias("tokens"),
    )
    stream = Window.partitionBy("rank", "shard").orderBy("_h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ends = placed.withColumn("_end", F.sum("size").over(stream)).join(
        shards, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard"))
    )
    passes = F.when(F.col("shard_size") > 0, F.expr("tokens div shard_size")).otherwise(F.lit(0))
    part = F.col("tokens") - F.col("_passes") * F.col("shard_size")
    start = F.col("_end") - F.col("size")
    taken = F.col("_passes") * F.col("size") + F.greatest(
        F.lit(0).cast("long"), F.least(F.col("_end"), part) - start
    )
    return ends.withColumn("_passes", passes.cast("long")).select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document taken twice is in the result twice; a document whose last pass is cut at a block
    end is there with the words up to that end, joined by spaces, since the blocks count words.
    """
    plan = mix(staged(word_sizes(docs)), **options).where("taken > 0")
    counted = plan.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_from")).agg(
        F.sort_array(F.collect_list("taken")).alias("_takes")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_from"))
        & (F.col("_n") == F.col("_size"))
    )
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    numbered = docs.withColumn("_n", size).join(counted, same).withColumn("_nth", F.lit(0))
    # rows that repeat an id, source and size share a list of takes; each row takes one of them
    if not docs.columns:
        return docs
    twin = Window.partitionBy("_id", "_from", "_size").orderBy("text")
    many = numbered.where(F.size("_takes") > 1).withColumn("_nth", F.row_number().over(twin) - 1)
    rows = numbered.where(F.size("_takes") == 1).unionByName(many)
    taken = F.get("_takes", "_nth")
    copies = F.sequence(F.lit(0).cast("long"), F.expr("(_taken + _n - 1) div _n") - 1)
    out = rows.withColumn("_taken", taken).withColumn("_pass", F.explode(copies))
    left = F.col("_taken") - F.col("_pass") * F.col("_n")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")
    changed = {"text": F.when(left >= F.col("_n"), F.col("text")).otherwise(cut)}
    out = out.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
