"""The published synthetic sample: 125 bills on three sheets.

``sample_bills.csv`` holds fixed values, as published; results over them are published too.
"""

import csv
from pathlib import Path

from pyspark.sql import functions as F

from ledgerspark import schema as S

SHEET_ROWS = 42
FIRST_ROW = 5


def bills() -> list[list[str]]:
    with Path(__file__).with_name("sample_bills.csv").open(newline="") as file:
        return list(csv.reader(file))[1:]


def source_rows(spark):
    """The sample as source rows of the fixed layout."""
    out = []
    for i, row in enumerate(bills()):
        sheet, offset = divmod(i, SHEET_ROWS)
        name, headers = S.FIXED_LAYOUT[sheet]
        number = FIRST_ROW + offset
        out.append((f"{sheet + 1}:{number}", 1, sheet + 1, name, number, headers, *row))
    df = spark.createDataFrame(
        out,
        "id string, file_ix int, sheet_ix int, source_sheet string, source_row bigint, "
        "headers array<string>, invoice_raw string, merchant_raw string, date_raw string, "
        "amount_raw string",
    )
    return df.select(
        "id", F.struct("file_ix", "sheet_ix", "source_row").alias("ord"),
        F.lit("sample").alias("source_file"), "source_sheet", "source_row", "headers",
        "invoice_raw", "merchant_raw", "date_raw", "amount_raw",
    )
