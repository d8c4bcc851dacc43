"""Reconciliation, totals and review workload.

Zero lines come from a union with a fixed list of zero rows, so filling costs no join.
Aggregates are map-side combined; sums are exact decimals.

``partial_totals`` makes all lines of a summary in one pass over the records.  Its lines can be
stored, merged with those of later records by ``merge_totals``, and read by ``lines_of``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.reasons import reason_keys
from ledgerspark.functions.text import cents_sum, month_key

CONTROL = "input"
WIDE = "decimal(38,0)"


def bills(records: DataFrame) -> DataFrame:
    """Retained rows."""
    return records.filter(F.col("status") == "clean")


def _spine(like: DataFrame, column: str, values: list[str]) -> DataFrame:
    spark = like.sparkSession
    items = F.array(*[F.lit(v) for v in values])
    return spark.range(1, numPartitions=1).select(F.explode(items).alias(column))


def _weight(df: DataFrame) -> Column:
    """Records that a row stands for: one, or those of a line of partial totals."""
    return F.col("rows") if "rows" in df.columns else F.lit(1)


def _cents(df: DataFrame) -> Column:
    """Sum of cents, of records or of lines of partial totals, whose sums are wide already."""
    wide = df.schema["cents"].dataType.simpleString() == WIDE
    return F.sum("cents") if wide else cents_sum("cents")


def _filled(df: DataFrame, column: str, spine: DataFrame | None) -> DataFrame:
    """``(column, cents, known)`` rows plus one empty row per spine value."""
    rows = df.select(column, "cents", _weight(df).alias("one"))
    if spine is None:
        return rows
    empty = spine.select(
        column, F.lit(None).cast("bigint").alias("cents"), F.lit(0).alias("one")
    )
    return rows.unionByName(empty)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def reconcile(records: DataFrame, with_excluded: bool = False) -> DataFrame:
    """Rows, known cents and unknown amounts per status, and the control total ``input``.

    Columns ``(status, rows, cents, unknown_rows)``; every known status has a line.
    """
    names = S.STATUSES_WITH_REVIEW if with_excluded else S.STATUSES
    return (
        _filled(records, "status", _spine(records, "status", names))
        .rollup("status")
        .agg(
            F.sum("one").alias("rows"),
            _zero(cents_sum("cents")).alias("cents"),
            F.count_if((F.col("one") == 1) & F.col("cents").isNull()).alias("unknown_rows"),
            F.grouping("status").alias("is_control"),
        )
        .select(
            F.when(F.col("is_control") == 1, CONTROL).otherwise(F.col("status")).alias("status"),
            "rows", "cents", "unknown_rows",
        )
    )


def monthly_totals(kept: DataFrame, spine: tuple[str, str] | None = None) -> DataFrame:
    """Net cents and rows per month; ``spine=('2025-01', '2025-12')`` fills the gaps."""
    months = None
    if spine is not None:
        first, last = (F.lit(f"{m}-01").cast("date") for m in spine)
        days = F.sequence(first, last, F.expr("interval 1 month"))
        months = kept.sparkSession.range(1, numPartitions=1).select(
            F.explode(F.transform(days, month_key)).alias("month")
        )
    return (
        _filled(kept if "month" in kept.columns else kept.withColumn("month", month_key("bill_date")), "month", months)
        .groupBy("month")
        .agg(_zero(_cents(kept)).alias("cents"), F.sum("one").alias("rows"))
        .orderBy("month")
    )


def category_totals(kept: DataFrame) -> DataFrame:
    """Net cents and rows per category, with a line for every known category."""
    return (
        _filled(kept, "category", _spine(kept, "category", S.ALL_CATEGORIES))
        .groupBy("category")
        .agg(_zero(_cents(kept)).alias("cents"), F.sum("one").alias("rows"))
        .orderBy("category")
    )


def merchant_totals(kept: DataFrame, top_n: int | None = None) -> DataFrame:
    """Net cents, rows and share per merchant, largest first."""
    totals = kept.groupBy("merchant").agg(
        _cents(kept).alias("cents"), F.sum(_weight(kept)).alias("rows")
    )
    order = [F.desc("cents"), F.asc("merchant")]
    total = totals.agg(F.sum("cents")).scalar()
    largest = totals.orderBy(*order).limit(1).select("merchant").scalar()
    out = totals.select(
        "merchant", "cents", "rows",
        F.try_divide(F.col("cents").cast("double"), total.cast("double")).alias("share"),
        (F.col("merchant") == largest).alias("is_largest"),
    ).orderBy(*order)
    return out if top_n is None else out.limit(top_n)


def high_bills(kept: DataFrame, high_cents: int, top_n: int | None = None) -> DataFrame:
    """Retained rows at or above the limit, refunds included, largest first."""
    out = kept.filter(F.abs("cents") >= high_cents).orderBy(F.desc(F.abs("cents")), "ord")
    return out if top_n is None else out.limit(top_n)


def totals_cube(kept: DataFrame) -> DataFrame:
    """Month, category, merchant and grand totals in one pass: ``(kind, label, cents, rows)``."""
    m, c, v = F.col("month"), F.col("category"), F.col("merchant")
    cube = (
        kept.select(month_key("bill_date").alias("month"), "category", "merchant", "cents")
        .groupingSets([[m], [c], [v], []], m, c, v)
        .agg(
            cents_sum("cents").alias("cents"), F.count("*").alias("rows"),
            F.grouping_id().alias("gid"),
        )
    )
    # grouping_id has one bit per column, set where the column is aggregated away
    kind = (
        F.when(F.col("gid") == 0b011, "month")
        .when(F.col("gid") == 0b101, "category")
        .when(F.col("gid") == 0b110, "merchant")
        .otherwise("all")
    )
    return cube.select(
        kind.alias("kind"), F.coalesce("month", "category", "merchant").alias("label"),
        _zero(F.col("cents")).alias("cents"), "rows",
    )


_LINE = ["kind", "label", "ord", "note"]


def partial_totals(records: DataFrame, high_cents: int) -> DataFrame:
    """Sums that later records can be added to: ``(kind, label, ord, note, cents, rows, unknown_rows,
    flagged_rows)``.

    ``kind`` is ``status`` for all records by status, and for retained ones ``month``, ``category``,
    ``merchant`` or ``high``: a line for each bill at or above the limit, with its place in the
    source ``ord``, the invoice as label and the merchant as note.  One pass over the records; only
    sums leave a task, and high bills.  Month and invoice may be null.
    """
    kept = F.col("status") == "clean"
    s, m, c, v, h = (F.col(x) for x in ("status", "month", "category", "merchant", "high"))
    bill = F.struct("ord", "invoice", "merchant")
    sets = (
        records.select(
            "status", "category", "merchant", "cents", month_key("bill_date").alias("month"),
            (F.size("reasons") > 0).alias("flagged"),
            F.when(kept & (F.abs("cents") >= high_cents), bill).alias("high"),
        )
        .groupingSets([[s], [s, m], [s, c], [s, v], [s, h]], s, m, c, v, h)
        .agg(
            F.grouping_id().alias("gid"), cents_sum("cents").alias("cents"), F.count("*").alias("rows"),
            F.count_if(F.col("cents").isNull()).alias("unknown_rows"), F.count_if("flagged").alias("flagged_rows"),
        )
    )
    # grouping_id has one bit per column, set where the column is aggregated away
    kind = (
        F.when(F.col("gid") == 0b01111, "status").when(F.col("gid") == 0b00111, "month")
        .when(F.col("gid") == 0b01011, "category").when(F.col("gid") == 0b01101, "merchant").otherwise("high")
    )
    label = (
        F.when(F.col("kind") == "status", s).when(F.col("kind") == "month", m)
        .when(F.col("kind") == "category", c).when(F.col("kind") == "merchant", v).otherwise(h["invoice"])
    )
    wanted = (F.col("kind") == "status") | (kept & ((F.col("kind") != "high") | h.isNotNull()))
    return sets.withColumn("kind", kind).filter(wanted).select(
        "kind", label.alias("label"), h["ord"].alias("ord"), h["merchant"].alias("note"),
        F.col("cents").cast(WIDE).alias("cents"), "rows", "unknown_rows", "flagged_rows",
    )


def merge_totals(parts: list[DataFrame]) -> DataFrame:
    """The partial totals of all records, from those of parts that share no record and one limit.

    Duplicates are found within one cleaning, so parts are parts of cleaned records.
    """
    counts = ["rows", "unknown_rows", "flagged_rows"]
    return reduce(DataFrame.unionByName, parts).groupBy(*_LINE).agg(
        F.sum("cents").cast(WIDE).alias("cents"), *[F.sum(c).alias(c) for c in counts]
    )


def lines_of(partial: DataFrame, kind: str) -> DataFrame:
    """Lines of one kind: input for the totals above, with the label under the name of the kind."""
    lines = partial.filter(F.col("kind") == kind)
    if kind == "high":
        return lines.select("ord", F.col("label").alias("invoice"), F.col("note").alias("merchant"), "cents")
    return lines.select(F.col("label").alias(kind), "cents", "rows", "unknown_rows", "flagged_rows")


def review_workload(records: DataFrame) -> DataFrame:
    """Rows per reason key; a row counts once per key."""
    return (
        records.select(F.explode(reason_keys("reasons")).alias("reason_key"))
        .groupBy("reason_key")
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "reason_key")
    )


def flagged_share(records: DataFrame) -> DataFrame:
    """One row: all rows, flagged rows and their share in percent."""
    return records.agg(
        F.count("*").alias("rows"), F.count_if(F.size("reasons") > 0).alias("flagged")
    ).withColumn(
        "percent", F.round(F.try_divide(F.col("flagged") * 100.0, F.col("rows").cast("double")), 4)
    )
