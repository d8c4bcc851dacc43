"""The per-field change log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import date_text, money_text
from ledgerspark.operators.skew import fits_broadcast

CHANGE_COLUMNS = [
    "id", "ord", "slot", "seq", "field", "before", "after", "rule", "who", "at",
    "source_file", "source_sheet", "source_row",
]
REVIEW_SLOT = 10
# source rows of a sheet that are numbered in one task
BLOCK_ROWS = 65_536


def _entries() -> Column:
    """All possible entries of one record, in log order."""
    candidates = [
        ("header", F.get("headers", F.lit(i)), F.lit(target), F.lit(S.RULE_HEADER))
        for i, target in enumerate(S.HEADER_TARGETS)
    ] + [
        ("invoice", F.col("invoice_raw"), F.col("invoice"), F.lit(S.RULE_INVOICE)),
        ("merchant", F.col("merchant_raw"), F.col("merchant"), F.lit(S.RULE_MERCHANT)),
        ("category", F.lit(""), F.col("category"), F.col("category_rule")),
        ("amount", F.col("amount_raw"), money_text("cents"), F.lit(S.RULE_AMOUNT)),
        ("date", F.col("date_raw"), date_text("bill_date"), F.lit(S.RULE_DATE)),
        ("disposition", F.lit("input"), F.col("status"), F.lit(S.RULE_DISPOSITION)),
    ]
    return F.array(
        *[
            F.struct(
                F.lit(slot).alias("slot"), F.lit(field).alias("field"), before.alias("before"),
                after.alias("after"), rule.alias("rule"),
            )
            for slot, (field, before, after, rule) in enumerate(candidates)
        ]
    )


def _who() -> Column:
    return F.when(F.col("rule") == S.RULE_CATEGORY_REVIEWER, "you").otherwise("build")


def build_changes(records: DataFrame) -> DataFrame:
    """Entries of the automatic cleanup: only where the value really changed.  No shuffle.

    Takes the records as cleaned, before reviewer decisions.
    """
    return (
        records.select(
            "id", "ord", "source_file", "source_sheet", "source_row", F.inline(_entries())
        )
        .filter(F.col("before") != F.col("after"))
        .withColumn("seq", F.lit(None).cast("bigint"))
        .withColumn("at", F.lit(None).cast("timestamp"))
        .withColumn("who", _who())
        .select(CHANGE_COLUMNS)
    )


def change_count() -> Column:
    """How many entries ``build_changes`` makes for a record."""
    return F.size(F.filter(_entries(), lambda e: e["before"] != e["after"]))


def numbered_build_changes(records: DataFrame) -> DataFrame:
    """``build_changes`` with a running number ``n`` in source order; the log is never sorted.

    The entries of a record are known before they are spread out.  Their counts are summed per
    block of ``BLOCK_ROWS`` source rows, and an exclusive scan over blocks, within a file and then
    over files, tells with which number a block starts.  Inside a block the scan goes on over
    its records, inside a record over its entries.  One exchange moves records, not entries; it
    cuts them into ranges of whole blocks, so that partitions and the rows in them are in the order
    of ``n``.  ``records`` are read more than once: write them first.
    """
    block = F.floor(F.col("ord.source_row") / BLOCK_ROWS).alias("_block")
    sheet = [F.col("ord.file_ix").alias("_file"), F.col("ord.sheet_ix").alias("_sheet"), block]
    sizes = records.select(*sheet, change_count().alias("_n")).groupBy("_file", "_sheet", "_block").agg(F.sum("_n").alias("_n"))
    earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = sizes.groupBy("_file").agg(F.sum("_n").alias("_all")).select(
        "_file", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before")
    )
    in_file = W.partitionBy("_file").orderBy("_sheet", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).join(files, "_file").select(
        "_file", "_sheet", "_block", (F.col("_from") + F.col("_before")).alias("_start")
    )
    in_block = W.partitionBy("_file", "_sheet", "_block").orderBy("ord", "id").rowsBetween(W.unboundedPreceding, -1)
    kept = F.filter(_entries(), lambda e: e["before"] != e["after"])
    place = ["id", "ord", "source_file", "source_sheet", "source_row", "_file", "_sheet", "_block"]
    # ranges are found from the places alone, and entries are made after the exchange
    ranged = records.select(*records.columns, *sheet).repartitionByRange("_file", "_sheet", "_block")
    listed = ranged.select(*place, kept.alias("_entries")).withColumn(
        "_ahead", F.coalesce(F.sum(F.size("_entries")).over(in_block), F.lit(0))
    )
    # one row per block; a join of broadcast rows keeps the order
    small = fits_broadcast(starts)
    numbered = (
        listed.join(F.broadcast(starts) if small else starts, ["_file", "_sheet", "_block"])
        .select("id", "ord", "source_file", "source_sheet", "source_row", "_start", "_ahead", F.posexplode("_entries").alias("_at", "_e"))
        .select("*", "_e.*")
        .withColumn("n", F.col("_start") + F.col("_ahead") + F.col("_at") + 1)
        .withColumn("seq", F.lit(None).cast("bigint"))
        .withColumn("at", F.lit(None).cast("timestamp"))
        .withColumn("who", _who())
        .select("n", *CHANGE_COLUMNS)
    )
    return numbered if small else numbered.repartitionByRange("n").sortWithinPartitions("n")


def change_log(build: DataFrame, reviewer: DataFrame) -> DataFrame:
    """Automatic and reviewer entries in one table; read it in ``(slot < 10, ord, slot, seq)``."""
    return build.select(CHANGE_COLUMNS).unionByName(reviewer.select(CHANGE_COLUMNS))


def change_facets(changes: DataFrame) -> DataFrame:
    """Distinct field, rule and sheet values as ``(facet, value)``; offered as filter choices."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("facet"), F.col(column).alias("value"))
            for name, column in [("field", "field"), ("rule", "rule"), ("sheet", "source_sheet")]
        ]
    )
    return changes.select(F.inline(pairs)).filter(F.col("value") != "").distinct()


def filter_changes(
    changes: DataFrame,
    id: str | None = None,
    who: str | None = None,
    field: str | None = None,
    rule: str | None = None,
    sheet: str | None = None,
) -> DataFrame:
    """Filter the change log; ``id`` gives one row's history without header and disposition
    entries of the automatic cleanup."""
    out = changes
    if id is not None:
        technical = F.col("field").isin("header", "disposition") & F.col("seq").isNull()
        out = out.filter((F.col("id") == id) & ~technical)
    for column, value in [("who", who), ("field", field), ("rule", rule), ("source_sheet", sheet)]:
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out
