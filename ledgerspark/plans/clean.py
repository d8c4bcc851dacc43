"""The cleaning plan: source rows and rules to records."""

from pyspark.sql import DataFrame

from ledgerspark import schema as S
from ledgerspark.functions.text import amount_cents, bill_date, strip_ws
from ledgerspark.operators.dedupe import (
    assign_status,
    build_reasons,
    hot_groups,
    mark_duplicates,
)
from ledgerspark.operators.rules import Rules, categorise
from ledgerspark.operators.skew import HOT_ROWS

# rows of a frequent group that a sample is to hold
SAMPLED_ROWS = 2000
SAMPLE_SEED = 17

RECORD_COLUMNS = [
    *S.SOURCE_ROW_COLUMNS,
    "invoice", "merchant", "category", "category_rule", "bill_date", "cents",
    "status", "duplicate_of", "possible_of", "reasons",
]


def parse_rows(rows: DataFrame) -> DataFrame:
    """Add the trimmed invoice, the date and the cents of every source row."""
    return (
        rows.withColumn("invoice", strip_ws("invoice_raw"))
        .withColumn("bill_date", bill_date("date_raw"))
        .withColumn("cents", amount_cents("amount_raw"))
    )


def frequent_groups(rows: DataFrame, rules: Rules, hot_rows: int = HOT_ROWS) -> list[int]:
    """Groups of about ``hot_rows`` rows or more, from a sample that a large group cannot escape.

    Every row is parsed once anyway; parsing all of them a second time for this list would cost as
    much as cleaning.  A group of ``hot_rows`` rows has ``SAMPLED_ROWS`` rows in the sample on
    average and is found from half of that; the list decides how rows are spread, never a result.
    """
    share = min(1.0, SAMPLED_ROWS / hot_rows)
    if share == 1.0:
        return hot_groups(categorise(parse_rows(rows), rules), hot_rows)
    some = rows.sample(share, SAMPLE_SEED)
    return hot_groups(categorise(parse_rows(some), rules), SAMPLED_ROWS // 2)


def clean(
    rows: DataFrame,
    rules: Rules,
    hot: list[int] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Clean source rows: one record per row, with status and review reasons.

    Parsing and categorising are row-local; one shuffle settles duplicates.  Groups of at least
    ``hot_rows`` rows are found first by a small job (see ``hot_groups``); a caller that cleans
    the same rows twice can pass its result as ``hot``, or an empty list when the input is known
    to have none.  Write the result before deriving several tables from it.
    """
    rules = rules.with_size()
    if hot is None:
        hot = frequent_groups(rows, rules, hot_rows)
    marked = assign_status(mark_duplicates(categorise(parse_rows(rows), rules), hot))
    return build_reasons(marked, rules.high_cents).select(RECORD_COLUMNS)
