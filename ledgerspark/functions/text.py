"""Scalar text, money and date expressions.

All of them are built-in Spark expressions, so they stay inside code generation and never
cross into Python.  Each one refers to its input only through short sub-expressions: nesting
a stripped copy of the text in every branch would multiply the expression tree.  Spark 4 runs
with ANSI casts by default, so user text is only ever passed to ``try_cast``.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark import schema as S

# Unicode whitespace (``trim`` alone only knows U+0020)
WHITESPACE = "".join(
    chr(c)
    for lo, hi in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(lo, hi + 1)
)
_WS = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]*"

# An amount is an optional currency mark, then a plain or grouped number with no or two
# decimals.  Parentheses mark a refund; the currency mark must follow the bracket directly.
_NUMBER = r"-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{2})?"
_MARKED = rf"(?:CAD{_WS}|\$)?{_WS}{_NUMBER}{_WS}"
_PLAIN = rf"^{_WS}{_MARKED}\z"
_REFUND = rf"^{_WS}\({_MARKED}\){_WS}\z"

_AMBIGUOUS = rf"^{_WS}[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}{_WS}\z"
_YMD = rf"^{_WS}(?!0000)([0-9]{{4}})([-/])([0-9]{{1,2}})\2(?: ([1-9])|([0-9]{{1,2}})){_WS}\z"
_DMY = (
    rf"^{_WS}([0-9]{{1,2}})-((?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-"
    rf"(?!0000)([0-9]{{4}}){_WS}\z"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def strip_ws(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.trim(text_or_empty(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    return strip_ws(c) == ""


def norm_key(c) -> Column:
    """Comparison key of a name: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]", "")


def _amount_value(text: Column) -> Column:
    """Number inside an accepted amount text; null when it has more than 36 integer digits."""
    return F.regexp_replace(text, "[^0-9.-]", "").try_cast("decimal(38,2)")


def amount_cents(c) -> Column:
    """Integer cents, or null where the text is not an accepted CAD amount or too large."""
    text = text_or_empty(c)
    value = _amount_value(text)
    # the digits without the point, so that no product can leave the range of a decimal
    cents = F.translate(value.cast("string"), ".", "").try_cast("bigint")
    return F.when(text.rlike(_PLAIN), cents).when(text.rlike(_REFUND) & (value >= 0), -cents)


def amount_error(c, cents: Column | None = None) -> Column:
    """Why the amount was not accepted, or null; pass ``cents`` when already computed."""
    text = text_or_empty(c)
    return F.when(
        (amount_cents(c) if cents is None else cents).isNull(),
        F.when(is_blank(text), S.R_MISSING_AMOUNT)
        .when(~text.rlike(_PLAIN) & ~text.rlike(_REFUND), S.R_INVALID_AMOUNT)
        .when(
            text.rlike(_REFUND) & (_amount_value(text) < 0), S.R_SIGNS
        )
        .otherwise(S.R_AMOUNT_RANGE),
    )


def bill_date(c) -> Column:
    """Date, or null where the text is missing, ambiguous or invalid."""
    text = text_or_empty(c)
    month = F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(text, _DMY, 2)))
    named = F.concat_ws(
        "-",
        F.regexp_extract(text, _DMY, 3),
        F.floor((month + 2) / 3).cast("string"),
        F.regexp_extract(text, _DMY, 1),
    )
    return F.when(
        text.rlike(_YMD), F.regexp_replace(text, _YMD, "$1-$3-$4$5").try_cast("date")
    ).when(text.rlike(_DMY), named.try_cast("date"))


def date_error(c, value: Column | None = None) -> Column:
    """Why the date was not accepted, or null; pass ``value`` when already computed."""
    text = text_or_empty(c)
    return F.when(
        (bill_date(c) if value is None else value).isNull(),
        F.when(is_blank(text), S.R_MISSING_DATE)
        .when(text.rlike(_AMBIGUOUS), S.R_AMBIGUOUS_DATE)
        .otherwise(S.R_INVALID_DATE),
    )


def date_text(c) -> Column:
    """ISO text of a date."""
    return as_col(c).cast("string")


def cents_as_amount(c) -> Column:
    """Cents as an exact decimal amount."""
    return (as_col(c).cast("decimal(20,2)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")


def money_text(c, grouping: bool = False) -> Column:
    """Cents as text with two decimals, optionally with thousands separators."""
    amount = cents_as_amount(c)
    return F.format_number(amount, 2) if grouping else amount.cast("string")


def month_key(c) -> Column:
    """``yyyy-MM`` of a date."""
    return F.substring(date_text(c), 1, 7)


def cents_sum(c) -> Column:
    """Exact sum of cents; widened because a bigint sum can overflow on very large inputs."""
    return F.sum(as_col(c).cast("decimal(18,0)"))


def threshold_label(high_cents: int) -> str:
    """Label of the high-amount limit, such as ``2,500`` or ``10.5``."""
    text = f"{Decimal(high_cents) / 100:,.2f}"
    return text.rstrip("0").rstrip(".")
