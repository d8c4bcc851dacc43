"""The five report tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.reasons import join_reasons
from ledgerspark.functions.text import cents_as_amount, cents_sum, month_key, threshold_label
from ledgerspark.operators import totals

_SOURCE = ["source_file", "source_sheet", "source_row"]


def _amount() -> Column:
    return cents_as_amount("cents").alias("amount")


def report_bills(records: DataFrame) -> DataFrame:
    """Retained bills."""
    return totals.bills(records).select(
        "ord", "id", "invoice", "bill_date", "merchant", "category", _amount(), "merchant_raw",
        *_SOURCE, join_reasons("reasons").alias("reasons"), month_key("bill_date").alias("month"),
    )


def report_needs_review(records: DataFrame) -> DataFrame:
    """Every flagged row with its source text."""
    return records.filter(F.size("reasons") > 0).select(
        "ord", "id", "status", join_reasons("reasons").alias("reasons"), "invoice",
        "merchant_raw", "date_raw", "amount_raw", _amount(), *_SOURCE,
    )


def report_duplicates(records: DataFrame) -> DataFrame:
    """Rows excluded as duplicates."""
    return records.filter(F.col("status") == "duplicate").select(
        "ord", "id", "duplicate_of", "invoice", "merchant", "bill_date", _amount(), *_SOURCE
    )


def report_change_log(changes: DataFrame) -> DataFrame:
    """Every field change; reviewer entries name the reviewer and the minute."""
    when = F.date_format("at", "yyyy-MM-dd HH:mm")
    by_reviewer = F.concat("rule", F.lit(" (you, "), when, F.lit(")"))
    return changes.select(
        "ord", "slot", "seq", "id", "field", "before", "after",
        F.when(F.col("seq").isNotNull(), by_reviewer).otherwise(F.col("rule")).alias("rule"),
        *_SOURCE,
    )


# the reading order of a summary
SUMMARY_ORDER = ["section", "place", "ord", "label"]


def _control_lines(records: DataFrame) -> DataFrame:
    def of(status: str) -> tuple[Column, Column]:
        here = F.col("status") == status
        return F.coalesce(cents_sum(F.when(here, F.col("cents"))), F.lit(0)), F.count_if(here)

    sums = {s: of(s) for s in S.STATUSES_WITH_REVIEW}
    facts = records.agg(
        *[c.alias(f"{s}_cents") for s, (c, _) in sums.items()],
        *[n.alias(f"{s}_rows") for s, (_, n) in sums.items()],
        F.coalesce(cents_sum("cents"), F.lit(0)).alias("all_cents"),
        F.count("*").alias("all_rows"),
        F.count_if(F.col("cents").isNull()).alias("unknown_rows"),
        F.count_if(F.size("reasons") > 0).alias("review_rows"),
    )
    return _control_table(facts)


def _control_lines_of(partial: DataFrame) -> DataFrame:
    """The same lines from partial totals."""
    here = {s: F.col("status") == s for s in S.STATUSES_WITH_REVIEW}
    by_status = totals.lines_of(partial, "status")
    return _control_table(by_status.agg(
        *[F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0)).alias(f"{s}_cents") for s, c in here.items()],
        *[F.coalesce(F.sum(F.when(c, F.col("rows"))), F.lit(0)).alias(f"{s}_rows") for s, c in here.items()],
        F.coalesce(F.sum("cents"), F.lit(0)).alias("all_cents"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in (("rows", "all_rows"), ("unknown_rows", "unknown_rows"), ("flagged_rows", "review_rows"))
        ],
    ))


def _control_table(facts: DataFrame) -> DataFrame:
    money = "decimal(38,0)"
    parts = sum((F.col(f"{s}_cents").cast(money) for s in S.STATUSES_WITH_REVIEW), F.lit(0))
    nothing = F.lit(None)
    lines = [
        ("Retained bills", F.col("clean_cents"), F.col("clean_rows"),
         "Includes possible duplicates; resolve review before posting."),
        ("Exact duplicates excluded", F.col("duplicate_cents"), F.col("duplicate_rows"),
         "Excluded from Bills; original rows retained."),
        ("Unparseable: known amounts", F.col("unparseable_cents"), F.col("unparseable_rows"),
         "Not included in monthly totals."),
        ("Excluded by reviewer", F.col("excluded_cents"), F.col("excluded_rows"),
         "Removed from Bills by a reviewer decision; amount kept in the control total."),
        ("All known input amounts", F.col("all_cents"), F.col("all_rows"),
         "Independent source control, before duplicate exclusion."),
        ("Reconciliation difference", parts - F.col("all_cents"), nothing,
         "Exact cents; must equal zero. Missing amounts stay unknown."),
        ("Unknown amounts", nothing, F.col("unknown_rows"),
         "Blank amounts are unknown, never treated as real zero."),
        ("Review rows", nothing, F.col("review_rows"),
         "Every flagged row, including duplicates."),
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"), F.lit(label).alias("label"),
                cents.cast(money).alias("cents"), rows.cast("bigint").alias("rows"),
                F.lit(note).alias("note"),
            )
            for i, (label, cents, rows, note) in enumerate(lines)
        ]
    )
    unused = (F.col("label") == "Excluded by reviewer") & (F.col("rows") == 0)
    return facts.select(F.inline(table)).filter(~unused)


def report_summary(
    records: DataFrame,
    high_cents: int,
    months: tuple[str, str] | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Control lines, then month, category, merchant and high-bill sections.

    Columns ``(section, place, ord, label, cents, rows, note)``; read it in ``SUMMARY_ORDER``:
    ``place`` is the line number in section 0 and minus the sorted-by amount where a section is
    sorted by amount; ``ord`` is the place of a high bill in the source, so that equal amounts
    keep the order of the source.  ``top_n`` shortens the merchant and high-bill sections.
    """
    kept = totals.bills(records)
    return _sections(
        _control_lines(records), totals.monthly_totals(kept, months), totals.category_totals(kept),
        totals.merchant_totals(kept, top_n), totals.high_bills(kept, high_cents, top_n),
    )


def summary_of_totals(
    partial: DataFrame, months: tuple[str, str] | None = None, top_n: int | None = None
) -> DataFrame:
    """``report_summary`` from ``totals.partial_totals``; the limit is the one of the totals.

    Every section reads the totals, so write them with ``stage`` first: the records are then read
    once, and totals of earlier records can be merged in instead of reading these again.
    """
    kinds = {k: totals.lines_of(partial, k) for k in ("month", "category", "merchant", "high")}
    high = kinds["high"].orderBy(F.desc(F.abs("cents")), "ord")
    return _sections(
        _control_lines_of(partial), totals.monthly_totals(kinds["month"], months),
        totals.category_totals(kinds["category"]), totals.merchant_totals(kinds["merchant"], top_n),
        high if top_n is None else high.limit(top_n),
    )


def _sections(
    control: DataFrame, by_month: DataFrame, by_category: DataFrame, merchants: DataFrame, high: DataFrame
) -> DataFrame:
    """The five sections under each other."""
    money = "decimal(38,0)"
    no_note = F.lit(None).cast("string")
    no_ord = F.lit(None).cast(high.schema["ord"].dataType).alias("ord")
    control = control.select(
        F.lit(0).alias("section"), F.col("place").cast(money).alias("place"), no_ord,
        "label", "cents", "rows", "note",
    )

    def section(no: int, df: DataFrame, label: str, place, note: Column) -> DataFrame:
        return df.select(
            F.lit(no).alias("section"), place.cast(money).alias("place"),
            F.col("ord") if "ord" in df.columns else no_ord,
            F.col(label).alias("label"), F.col("cents").cast(money).alias("cents"),
            F.col("rows").cast("bigint").alias("rows"), note.alias("note"),
        )

    zero = F.lit(0)
    high = high.select("ord", "invoice", "cents", F.lit(None).alias("rows"), "merchant")
    parts = [
        section(1, by_month, "month", zero, no_note),
        section(2, by_category, "category", zero, no_note),
        section(3, merchants, "merchant", -F.col("cents"),
                F.when(F.col("is_largest"), "Largest merchant")),
        section(4, high, "invoice", -F.abs("cents"), F.col("merchant")),
    ]
    for part in parts:
        control = control.unionByName(part)
    return control


def summary_titles(high_cents: int) -> dict[int, str]:
    """Heading of every summary section."""
    return {
        1: "MONTHLY TOTALS",
        2: "CATEGORY TOTALS",
        3: "MERCHANT TOTALS",
        4: "HIGH BILLS | absolute CAD >= " + threshold_label(high_cents),
    }
