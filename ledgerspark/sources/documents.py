"""Small documents and logs: rules, suggestion cache and decisions."""

import json
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import WHITESPACE
from ledgerspark.operators.checks import cache_problem, check_cache
from ledgerspark.operators.review import ACTIONS
from ledgerspark.operators.rules import Rules, rules_from_pairs


def threshold_cents(value) -> int:
    """High-amount limit in cents; non-negative, finite, at most two decimals."""
    if isinstance(value, bool):
        raise ValueError("high-amount limit must be a number")
    try:
        amount = Decimal(str(value))
    except InvalidOperation:
        raise ValueError("high-amount limit must be a number") from None
    if not amount.is_finite() or amount < 0 or amount * 100 != int(amount * 100):
        raise ValueError("high-amount limit must be non-negative with at most two decimals")
    return int(amount * 100)


def _norm(alias: str) -> str:
    return "".join(c for c in alias.lower() if c.isascii() and c.isalnum())


def parse_rules(text: str, mode: str = "strict") -> tuple[list[tuple[str, str]], int | None]:
    """Pairs ``(alias, category)`` and the limit in cents from a rules document.

    ``strict`` refuses anything unexpected; ``lenient`` leaves bad entries out and may find no
    limit.
    """
    document = json.loads(text.removeprefix("﻿"))
    if mode == "lenient":
        pairs = {}
        for item in document.get("aliases") or []:
            alias, category = item.get("alias"), item.get("category")
            if alias and category in S.ALL_CATEGORIES and _norm(str(alias)):
                pairs[_norm(str(alias))] = (str(alias), category)
        high = document.get("high_cad")
        return list(pairs.values()), round(high * 100) if high else None
    if not isinstance(document, dict) or set(document) != {"aliases", "high_cad"}:
        raise ValueError("rules must contain exactly aliases and high_cad")
    if not isinstance(document["aliases"], list):
        raise ValueError("rules aliases must be a list")
    if not isinstance(document["high_cad"], (int, float)):
        raise ValueError("rules high_cad must be a number")
    high_cents = threshold_cents(document["high_cad"])
    pairs = {}
    for item in document["aliases"]:
        if not isinstance(item, dict) or set(item) != {"alias", "category"}:
            raise ValueError("each rule must contain exactly alias and category")
        alias, category = item["alias"], item["category"]
        if not isinstance(alias, str) or not _norm(alias):
            raise ValueError("rule alias must contain letters or digits")
        if category not in S.ALL_CATEGORIES:
            raise ValueError("rule category outside the allowed set")
        if _norm(alias) in pairs:
            raise ValueError("rules contain the same alias twice: " + alias)
        pairs[_norm(alias)] = (alias.strip(WHITESPACE), category)
    return list(pairs.values()), high_cents


def load_rules(
    spark: SparkSession,
    path: str,
    mode: str = "strict",
    high_cents: int | None = None,
) -> Rules:
    """Reviewer rules from a JSON document; ``high_cents`` must agree with it when given."""
    documents = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(documents) != 1:
        raise ValueError("expected exactly one rules document at " + path)
    pairs, found = parse_rules(documents[0]["value"], mode)
    if mode == "strict" and high_cents is not None and high_cents != found:
        raise ValueError("rules high_cad conflicts with the configured limit")
    if found is None:
        found = S.DEFAULT_HIGH_CENTS if high_cents is None else high_cents
    return rules_from_pairs(spark, pairs, "reviewer", found)


_CACHE_DOCUMENT = (
    "provider string, model string, generated string, "
    "entries map<string, struct<merchant: string, category: string, confidence: double, "
    "reason: string>>"
)


def load_suggestion_cache(spark: SparkSession, path: str) -> DataFrame:
    """Suggestion cache from its JSON document; raises when it is not well formed."""
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", _CACHE_DOCUMENT).alias("d")
    )
    cache = document.select(
        F.explode("d.entries").alias("norm_key", "e"), "d.provider", "d.model", "d.generated"
    ).select(
        "norm_key", "e.merchant", "e.category", "e.confidence",
        F.coalesce("e.reason", F.lit("")).alias("reason"), "provider", "model",
        F.col("generated").try_cast("date").alias("generated"),
    )
    verdict = check_cache(cache).first()
    if not verdict["ok"]:
        raise ValueError("suggestion cache is not well formed")
    return cache


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Append-only decision log, one JSON object per line."""
    return spark.read.schema(S.DECISIONS).json(path)


@dataclass(frozen=True)
class Read:
    """What was read: usable rows, and everything refused with its ``reason``."""

    rows: DataFrame
    rejects: DataFrame


def read_cache(spark: SparkSession, path: str) -> Read:
    """Suggestion cache from a table that ``write_cache`` wrote; damaged entries are rejects."""
    entries = spark.read.schema(S.SUGGESTION_CACHE).parquet(path).withColumn("reason_", cache_problem())
    bad = entries.filter(F.col("reason_").isNotNull())
    return Read(
        entries.filter(F.col("reason_").isNull()).drop("reason_"),
        bad.select("norm_key", "merchant", F.col("reason_").alias("reason")),
    )


BROKEN_LINE = "not a decision"
INCOMPLETE = "decision without a number, id, row or action"
UNKNOWN_ACTION = "unknown action"
REPEATED_LINE = "line given again"
REUSED_NUMBER = "one number for different decisions"


def read_decisions(spark: SparkSession, path: str) -> Read:
    """Decision log, one JSON object per line; damaged lines are rejects ``(line, copies, reason)``.

    A line given several times counts once, its further copies are rejects.  Different lines with
    one number are all refused, because their order is unknown.  Blank lines are skipped.
    """
    parsed = f"{S.DECISIONS.simpleString()[7:-1]},_broken:string"
    lines = spark.read.text(path).filter(F.trim("value") != "").groupBy("value").agg(F.count("*").alias("n"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    read = lines.withColumn("d", F.from_json("value", f"struct<{parsed}>", options))
    set_ = F.col("d.seq").isNotNull() & F.col("d.id").isNotNull() & F.col("d.action").isNotNull()
    judged = read.withColumn(
        "reason",
        F.when(F.col("d").isNull() | F.col("d._broken").isNotNull(), BROKEN_LINE)
        .when(~set_ | F.col("d.row_id").isNull() & (F.col("d.action") != "undo"), INCOMPLETE)
        .when(~F.col("d.action").isin([*ACTIONS, "undo"]), UNKNOWN_ACTION),
    )
    good = judged.filter("reason is null")
    numbers = good.groupBy(F.col("d.seq").alias("seq")).agg(F.count("*").alias("k")).filter("k > 1")
    told = good.join(numbers, good["d.seq"] == numbers["seq"], "left")
    one = told.filter("k is null")
    rejects = [
        (judged.filter("reason is not null"), F.col("n"), F.col("reason")),
        (told.filter("k is not null"), F.col("n"), F.lit(REUSED_NUMBER)),
        (one.filter("n > 1"), F.col("n") - 1, F.lit(REPEATED_LINE)),
    ]
    parts = [df.select(F.col("value").alias("line"), n.alias("copies"), r.alias("reason")) for df, n, r in rejects]
    refused = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Read(one.select(*[f"d.{c}" for c in S.DECISIONS.fieldNames()]), refused)


def decision_gaps(decisions: DataFrame) -> DataFrame:
    """Numbers that a log leaves out: ``(first, last)`` of every run between two of its numbers.

    One range sort; the edges of the parts are compared in one small table.
    """
    parts = int(decisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = decisions.select("seq").filter("seq is not null").repartitionByRange(parts, "seq")
    # steps inside the parts and their edges must come from the same cut
    placed = placed.withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    here = placed.withColumn("_before", F.lag("seq").over(W.partitionBy("_part").orderBy("seq")))
    # one row per part; the first number of a part follows the last one of the part before
    edges = here.groupBy("_part").agg(F.min("seq").alias("seq"), F.max("seq").alias("_last"))
    edges = edges.withColumn("_before", F.lag("_last").over(W.orderBy("_part")))
    steps = here.select("seq", "_before").unionByName(edges.select("seq", "_before"))
    return steps.filter(F.col("seq") > F.col("_before") + 1).select(
        (F.col("_before") + 1).alias("first"), (F.col("seq") - 1).alias("last")
    )
