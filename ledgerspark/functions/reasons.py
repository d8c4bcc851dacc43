"""Expressions over review reasons and merchant names."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import text_or_empty


def reason_key(reason: Column) -> Column:
    """Stable key of one review reason; unknown texts become ``other``."""
    return (
        F.when(reason == S.R_UNMAPPED, "unmapped")
        .when(reason.startswith("high amount"), "high")
        .when(reason.startswith("exact duplicate of"), "exactdup")
        .when(reason.startswith("possible duplicate of"), "possibledup")
        .when(reason == S.R_MISSING_DATE, "missingdate")
        .when(reason == S.R_MISSING_AMOUNT, "missingamount")
        .when(reason.startswith("invalid amount"), "invalidamount")
        .when(reason == S.R_INVALID_DATE, "invaliddate")
        .when(reason.startswith("ambiguous date"), "ambiguousdate")
        .when(reason.endswith("by reviewer"), "reviewer")
        .otherwise("other")
    )


def reason_keys(reasons) -> Column:
    """Distinct keys of a row's reasons."""
    reasons = F.col(reasons) if isinstance(reasons, str) else reasons
    return F.array_distinct(F.transform(reasons, reason_key))


def keyword_guess(merchant) -> Column:
    """Category of the first keyword pattern found in a merchant name, or null."""
    text = text_or_empty(merchant)
    return F.coalesce(*[F.when(text.rlike(f"(?i){rx}"), cat) for rx, cat in S.KEYWORDS])


def keyword_reason(merchant) -> Column:
    """Short explanation of ``keyword_guess``."""
    text = text_or_empty(merchant)
    hits = [
        F.when(text.rlike(f"(?i){rx}"), f"name matches keyword {rx.split('|')[0]}")
        for rx, _ in S.KEYWORDS
    ]
    miss = F.lit("no keyword match — a simulated rule cannot guess this name")
    return F.coalesce(*hits, miss)


def any_reason(reasons: Column, test) -> Column:
    return F.exists(reasons, test)


def join_reasons(reasons) -> Column:
    return F.array_join(reasons, "; ")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
