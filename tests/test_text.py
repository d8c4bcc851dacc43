import datetime as dt

import pytest

from ledgerspark import schema as S
from ledgerspark.functions import reasons as fr
from ledgerspark.functions import text as ft

INVALID, MISSING = S.R_INVALID_AMOUNT, S.R_MISSING_AMOUNT

AMOUNTS = [
    ("CAD 1,234.50", 123450, None), ("$1,234.50", 123450, None), ("1234.50", 123450, None),
    ("(CAD 1,250.00)", -125000, None), ("(CAD 5.00)", -500, None), ("( 5.00 )", -500, None),
    ("( CAD 5.00)", None, INVALID), ("CAD $5.00", None, INVALID), ("-$5.00", None, INVALID),
    ("CAD -5.00", -500, None), ("1.5", None, INVALID), ("1.999", None, INVALID),
    ("()", None, INVALID), ("", None, MISSING), ("   ", None, MISSING),
    ("(-5.00)", None, S.R_SIGNS), ("(-0.00)", 0, None), ("0.00", 0, None), ("CAD 0.00", 0, None),
    ("12,34.00", None, INVALID), ("--1.00", None, INVALID), ("USD 4.00", None, INVALID),
    ("(5.00", None, INVALID), ("٣.00", None, INVALID), ("CAD5", 500, None),
    ("cad 5", None, INVALID), (" 7.00 ", 700, None), ("5.00\n", 500, None),
    ("9999999999999999.99", 999999999999999999, None),
    ("12345678901234567", 1234567890123456700, None), ("99999999999999999999", None, S.R_AMOUNT_RANGE),
    ("9" * 60, None, S.R_AMOUNT_RANGE),
    ("-1,000.25", -100025, None), ("CAD 5.00", 500, None),
]

DATES = [
    ("2025-01-02", dt.date(2025, 1, 2), None), ("2025/1/2", dt.date(2025, 1, 2), None),
    ("2025-1/2", None, S.R_INVALID_DATE), ("08-Mar-2025", dt.date(2025, 3, 8), None),
    ("8-MAR-2025", dt.date(2025, 3, 8), None), ("08-march-2025", None, S.R_INVALID_DATE),
    ("0000-01-01", None, S.R_INVALID_DATE), ("0001-01-01", dt.date(1, 1, 1), None),
    ("2025-02-30", None, S.R_INVALID_DATE), ("29-Feb-2024", dt.date(2024, 2, 29), None),
    ("03/04/2025", None, S.R_AMBIGUOUS_DATE), ("3/4/2025", None, S.R_AMBIGUOUS_DATE),
    ("", None, S.R_MISSING_DATE), ("　", None, S.R_MISSING_DATE),
    ("2025-1- 5", dt.date(2025, 1, 5), None), ("25-01-02", None, S.R_INVALID_DATE),
    ("2025-13-01", None, S.R_INVALID_DATE), (" 2025-01-02 ", dt.date(2025, 1, 2), None),
    ("00-Jan-2024", None, S.R_INVALID_DATE), ("2025-01-02x", None, S.R_INVALID_DATE),
]


def test_amounts(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in AMOUNTS], "a string")
    got = df.select("a", ft.amount_cents("a"), ft.amount_error("a")).collect()
    assert [tuple(r) for r in got] == AMOUNTS


def test_dates(spark):
    df = spark.createDataFrame([(d,) for d, _, _ in DATES], "d string")
    got = df.select("d", ft.bill_date("d"), ft.date_error("d")).collect()
    assert [tuple(r) for r in got] == DATES


def test_scalars_need_no_python(spark):
    df = spark.createDataFrame([("x",)], "a string").select(
        ft.amount_cents("a"), ft.amount_error("a"), ft.bill_date("a"), ft.date_error("a"),
        ft.norm_key("a"), ft.strip_ws("a"), fr.keyword_guess("a"),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_strip_and_norm(spark):
    df = spark.createDataFrame([("  A-b Cé ",), (None,)], "a string")
    got = df.select(ft.strip_ws("a"), ft.norm_key("a")).collect()
    assert [tuple(r) for r in got] == [("A-b Cé", "abc"), ("", "")]


def test_money_and_month(spark):
    df = spark.createDataFrame(
        [(123450, dt.date(2025, 3, 8)), (-5, dt.date(2025, 12, 1)), (None, None)],
        "c bigint, d date",
    )
    got = df.select(ft.money_text("c"), ft.money_text("c", True), ft.month_key("d")).collect()
    assert [tuple(r) for r in got] == [
        ("1234.50", "1,234.50", "2025-03"), ("-0.05", "-0.05", "2025-12"), (None, None, None),
    ]


@pytest.mark.parametrize(
    "cents,label", [(250000, "2,500"), (1050, "10.5"), (0, "0"), (123456789, "1,234,567.89")]
)
def test_threshold_label(cents, label):
    assert ft.threshold_label(cents) == label


def test_reason_keys(spark):
    texts = [
        (S.R_UNMAPPED, "unmapped"), (S.R_HIGH_PREFIX + "2,500", "high"),
        ("exact duplicate of 1:5", "exactdup"),
        ("possible duplicate of 1:5; retained for review", "possibledup"),
        (S.R_MISSING_DATE, "missingdate"), (S.R_MISSING_AMOUNT, "missingamount"),
        (S.R_INVALID_AMOUNT, "invalidamount"), (S.R_INVALID_DATE, "invaliddate"),
        (S.R_AMBIGUOUS_DATE, "ambiguousdate"), (S.R_EXCLUDED, "reviewer"),
        ("marked duplicate of 1:5 by reviewer", "reviewer"), (S.R_SIGNS, "other"),
        (S.R_AMOUNT_RANGE, "other"),
    ]
    df = spark.createDataFrame(texts, "r string, k string")
    from pyspark.sql import functions as F

    assert df.filter(fr.reason_key(F.col("r")) != F.col("k")).count() == 0


def test_keywords(spark):
    names = [
        ("Northwind Office Supplies", "Supplies"), ("Summit Plaza Leasing", None),
        ("Maple HYDRO", "Utilities"), ("Nimbus Hosting", "Software"), ("Toner Depot", None),
        ("Kestrel Freight", "Transport"), ("Rent office", "Supplies"),
    ]
    df = spark.createDataFrame(names, "m string, c string")
    got = df.select("m", fr.keyword_guess("m")).collect()
    assert [tuple(r) for r in got] == names
