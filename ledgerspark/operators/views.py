"""Filtered, sorted and paged views of records, and duplicate pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.reasons import all_of, reason_keys
from ledgerspark.functions.text import month_key
from ledgerspark.operators.skew import salted_join


def is_flagged() -> Column:
    return F.size("reasons") > 0


def needs_review(records: DataFrame) -> DataFrame:
    """Rows with any review reason."""
    return records.filter(is_flagged())


def filter_bills(
    records: DataFrame,
    q: str | None = None,
    category: str | None = None,
    month: str | None = None,
    flag: str | None = None,
    reason: str | None = None,
    include_excluded: bool = False,
) -> DataFrame:
    """Search and filter; all conditions must hold.

    ``q`` is searched in merchant, invoice and the four source cells; ``flag`` is ``flagged`` or
    ``clean``; ``reason`` is a reason key.  Only retained rows unless ``include_excluded``.
    """
    tests = []
    if not include_excluded:
        tests.append(F.col("status") == "clean")
    if q:
        cells = ["merchant", "invoice", *(f"{f}_raw" for f in S.FIELDS)]
        tests.append(F.lower(F.concat_ws(" ", *cells)).contains(q.lower()))
    if category:
        tests.append(F.col("category") == category)
    if month:
        tests.append(month_key("bill_date") == month)
    if flag == "flagged":
        tests.append(is_flagged())
    elif flag == "clean":
        tests.append(~is_flagged())
    if reason:
        tests.append(F.array_contains(reason_keys("reasons"), reason))
    return records.filter(all_of(tests))


def filter_ledger(
    records: DataFrame, sheet: str = "all", search: str = "", reason: str = "all"
) -> DataFrame:
    """Ledger view: status tab, merchant search, reason group (review, category, missing)."""
    tests = []
    if sheet != "all":
        tests.append(F.col("status") == sheet)
    if search.strip():
        tests.append(F.lower("merchant").contains(search.strip().lower()))
    if reason == "review":
        tests.append(is_flagged())
    elif reason == "category":
        tests.append(F.col("category") == S.UNCATEGORISED)
    elif reason == "missing":
        tests.append(F.exists("reasons", lambda r: r.startswith("missing")))
    elif reason != "all":
        raise ValueError("unknown reason group " + reason)
    return records.filter(all_of(tests))


def filter_queue(queue: DataFrame, key: str = "all") -> DataFrame:
    """Review queue restricted to a reason key, or to ``decided`` rows."""
    if key == "all":
        return queue
    hit = F.array_contains(reason_keys("reasons"), key)
    return queue.filter(hit | F.col("decided").isNotNull() if key == "decided" else hit)


def sort_bills(df: DataFrame, key: str = "date", direction: str = "asc") -> DataFrame:
    """Sort by src, invoice, date, merchant, category or amount; unknown values come lowest,
    equal values keep the processing order."""
    columns = {"src": "ord", "date": "bill_date", "amount": "cents"}
    if key not in {*columns, "invoice", "merchant", "category"}:
        raise ValueError("unknown sort key " + key)
    col = F.col(columns.get(key, key))
    first = col.desc_nulls_last() if direction == "desc" else col.asc_nulls_first()
    return df.orderBy(first, "ord")


def review_queue(records: DataFrame, sort: str = "source") -> DataFrame:
    """Flagged or decided rows, undecided first; by source order or by absolute amount.

    An unknown amount ranks as one cent.
    """
    queue = records.filter(is_flagged() | F.col("decided").isNotNull())
    undecided_first = F.col("decided").isNotNull().asc()
    if sort == "amount":
        size = F.abs(F.coalesce("cents", F.lit(-1)))
        return queue.orderBy(undecided_first, size.desc(), "ord")
    return queue.orderBy(undecided_first, "ord")


def page(df: DataFrame, order: list, n: int, size: int = 200) -> DataFrame:
    """Page ``n`` (from 0) of a table; ``order`` must be a total order."""
    return df.orderBy(*order).offset(n * size).limit(size)


_SIDE = ["id", "invoice", "bill_date", "merchant", "cents"]


def _pairs(records: DataFrame, rows: DataFrame, link: str) -> DataFrame:
    """Each row next to the row its ``link`` column names; many rows may name the same one."""
    left = rows.select(F.col(link).alias("original_id"), *_SIDE)
    originals = records.select(
        F.col("id").alias("original_id"), F.lit(True).alias("original_found"),
        *[F.col(c).alias(f"original_{c}") for c in _SIDE if c != "id"],
    )
    return salted_join(left, originals, ["original_id"], "id").withColumn(
        "original_found", F.coalesce("original_found", F.lit(False))
    )


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """Every duplicate next to the row it repeats; nulls where that row is missing."""
    return _pairs(records, records.filter(F.col("status") == "duplicate"), "duplicate_of")


def possible_duplicate_pairs(records: DataFrame) -> DataFrame:
    """Every possible duplicate next to the first row of its group."""
    return _pairs(records, records.filter(F.col("possible_of").isNotNull()), "possible_of")
