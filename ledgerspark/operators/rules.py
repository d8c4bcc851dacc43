"""Merchant rules: built-in and reviewer rules, categorisation and rule impact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import cents_as_amount, norm_key, strip_ws
from ledgerspark.operators.skew import BROADCAST_ROWS, fits_broadcast, lookup_join


@dataclass(frozen=True)
class Rules:
    """Rules table ``(norm_key, alias, category, origin, rule_id)`` and the high-amount limit.

    ``rows`` is an upper bound of the table's size when it is known; it decides whether the
    table may be broadcast.
    """

    df: DataFrame
    high_cents: int = S.DEFAULT_HIGH_CENTS
    rows: int | None = None

    def with_size(self) -> Rules:
        if self.rows is not None:
            return self
        return replace(self, rows=BROADCAST_ROWS) if fits_broadcast(self.df) else self


def rules_from_pairs(
    spark: SparkSession,
    pairs: Iterable[tuple],
    origin: str,
    high_cents: int = S.DEFAULT_HIGH_CENTS,
) -> Rules:
    """Rules from ``(alias, category)`` or ``(alias, category, rule_id)`` tuples."""
    rows = [(p[0], p[1], p[2] if len(p) > 2 else None) for p in pairs]
    df = spark.createDataFrame(rows, "alias string, category string, rule_id string").select(
        norm_key("alias").alias("norm_key"),
        strip_ws("alias").alias("alias"),
        "category",
        F.lit(origin).alias("origin"),
        "rule_id",
    )
    return Rules(df, high_cents, len(rows))


def builtin_rules(spark: SparkSession, high_cents: int = S.DEFAULT_HIGH_CENTS) -> Rules:
    return rules_from_pairs(spark, S.SAMPLE_MERCHANTS, "builtin", high_cents)


def effective_rules(builtin: Rules, reviewer: Rules | None) -> Rules:
    """Reviewer rules replace built-in ones with the same key; the reviewer limit applies."""
    if reviewer is None:
        return builtin
    kept = builtin.df.join(reviewer.df.select("norm_key"), "norm_key", "left_anti")
    rows = None if None in (builtin.rows, reviewer.rows) else builtin.rows + reviewer.rows
    return Rules(reviewer.df.unionByName(kept), reviewer.high_cents, rows)


def categorise(rows: DataFrame, rules: Rules) -> DataFrame:
    """Add canonical ``merchant``, ``category`` and the rule text behind the category."""
    rules = rules.with_size()
    named = rows.withColumn("norm_key", norm_key("merchant_raw"))
    table = rules.df.select(
        "norm_key", F.col("alias").alias("_alias"), F.col("category").alias("_category"),
        F.col("origin").alias("_origin"),
    )
    joined = lookup_join(named, table, ["norm_key"], "id", rules.rows)
    category = F.coalesce("_category", F.lit(S.UNCATEGORISED))
    return (
        joined.withColumn("merchant", F.coalesce("_alias", strip_ws("merchant_raw")))
        .withColumn("category", category)
        .withColumn(
            "category_rule",
            F.when(category == S.UNCATEGORISED, S.RULE_CATEGORY_NONE)
            .when(F.col("_origin") == "reviewer", S.RULE_CATEGORY_REVIEWER)
            .otherwise(S.RULE_CATEGORY_BUILTIN),
        )
        .drop("norm_key", "_alias", "_category", "_origin")
    )


def rule_impact(rows: DataFrame, rules: Rules) -> DataFrame:
    """Input rows matched per rule, and how many of them meet the high-amount limit.

    ``rows`` needs ``merchant_raw`` and ``cents``.  Rows are counted per distinct name before
    the join, so the join sees one row per name and rule.
    """
    per_name = (
        rows.select(
            norm_key("merchant_raw").alias("norm_key"),
            (F.abs("cents") >= rules.high_cents).alias("high"),
        )
        .groupBy("norm_key")
        .agg(F.count("*").alias("n"), F.count_if("high").alias("h"))
    )
    return rules.df.join(per_name, "norm_key", "left").select(
        "alias",
        "category",
        "origin",
        F.coalesce("n", F.lit(0)).alias("matched_rows"),
        F.coalesce("h", F.lit(0)).alias("high_rows"),
    )


def rule_snapshot(rules: Rules) -> DataFrame:
    """The rules document as rows, for comparing two policies."""
    return rules.df.select("alias", "category").withColumn(
        "high_cad", cents_as_amount(F.lit(rules.high_cents))
    )


def check_rule_snapshot(given: Rules, stored: Rules) -> DataFrame:
    """One row ``(missing, unexpected, limit_differs, ok)`` comparing two reviewer policies."""
    pairs = ["alias", "category"]
    g, s = given.df.select(pairs), stored.df.select(pairs)
    sides = (
        g.withColumn("side", F.lit(1))
        .unionByName(s.withColumn("side", F.lit(-1)))
        .groupBy(pairs)
        .agg(F.sum("side").alias("d"))
    )
    differs = F.lit(given.high_cents != stored.high_cents)
    return sides.agg(
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("unexpected"),
        differs.alias("limit_differs"),
    ).withColumn(
        "ok", (F.col("missing") == 0) & (F.col("unexpected") == 0) & ~F.col("limit_differs")
    )
