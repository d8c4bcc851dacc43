"""Messy bills derived from the ``orders`` and ``customer`` tables.

Every order becomes one bill whose text fields are spoiled by rules on the order key ``k``;
some orders are repeated as exact or possible duplicates.  The true values stay known, so a
database can compute the expected results without parsing any text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.rules import Rules, rules_from_pairs
from ledgerspark.sources.tables import source_rows_from_table

SEGMENT_CATEGORY = [
    ("AUTOMOBILE", "Transport"),
    ("BUILDING", "Rent"),
    ("FURNITURE", "Supplies"),
    ("HOUSEHOLD", "Utilities"),
    ("MACHINERY", "Software"),
]
NAMED_VENDORS = 30
VENDORS = 40
HIGH_CENTS = 40_000_000
HEADERS = ["Invoice", "Vendor", "Date", "Amount"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows over the configured number of shuffle partitions.

    The number is stated: the rows are small but costly to parse, and Spark would merge partitions
    by their bytes alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def dirty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, invoice_raw, merchant_raw, date_raw, amount_raw)``."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("k")
    true = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("k"),
        F.col("c_mktsegment").alias("seg"),
        (F.col("o_custkey") % VENDORS).cast("string").alias("v"),
        F.col("o_orderdate").cast("date").alias("dt"),
        (
            F.round(F.col("o_totalprice") * 100).cast("bigint")
            * F.when(F.col("o_orderkey") % 19 == 0, -1).otherwise(1)
        ).alias("c"),
    )
    copies = F.array_compact(
        F.array(F.lit(0), F.when(k % 41 == 0, 1), F.when(k % 67 == 0, 2))
    )
    rows = true.withColumn("copy", F.explode(copies))
    # parts used several times below are computed once, in a step of their own
    parts = rows.select(
        "k", "dt", "c", "copy",
        F.concat(
            F.lit("INV-"), F.lpad(k.cast("string"), 8, "0"),
            F.when(F.col("copy") == 2, "-COPY").otherwise(""),
        ).alias("number"),
        F.concat_ws(" ", "seg", F.lit("vendor"), "v").alias("name"),
        F.format_number((F.abs("c") / 100).cast("decimal(18,2)"), 2).alias("grouped"),
    )
    number, name, grouped = F.col("number"), F.col("name"), F.col("grouped")
    plain = F.translate(grouped, ",", "")
    minus = F.when(F.col("c") < 0, "-").otherwise("")
    return parts.select(
        (k * 10 + F.col("copy")).alias("ord"),
        F.when(k % 5 == 0, F.concat(F.lit("  "), number, F.lit(" ")))
        .otherwise(number)
        .alias("invoice_raw"),
        F.when(k % 4 == 0, name)
        .when(k % 4 == 1, F.lower(name))
        .when(k % 4 == 2, F.concat(F.lit("  "), F.translate(name, " ", "-")))
        .otherwise(F.upper(name))
        .alias("merchant_raw"),
        F.when(k % 101 == 0, "")
        .when(k % 103 == 0, "03/04/2025")
        .when(k % 107 == 0, "2025-02-30")
        .when(k % 3 == 0, F.date_format("dt", "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format("dt", "yyyy/MM/dd"))
        .otherwise(F.date_format("dt", "dd-MMM-yyyy"))
        .alias("date_raw"),
        F.when(k % 109 == 0, "")
        .when(k % 113 == 0, "USD 45.00")
        .when(k % 127 == 0, "CAD 12,34.00")
        .when(k % 3 == 0, F.concat(F.lit("CAD "), minus, grouped))
        .when((k % 3 == 1) & (F.col("c") < 0), F.concat(F.lit("($"), grouped, F.lit(")")))
        .when(k % 3 == 1, F.concat(F.lit("$"), grouped))
        .when(F.col("c") < 0, F.concat(F.lit("(CAD "), grouped, F.lit(")")))
        .otherwise(plain)
        .alias("amount_raw"),
    )


def dirty_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy bills as source rows."""
    return source_rows_from_table(
        dirty_table(spark, sf_dir),
        {f: f"{f}_raw" for f in ("invoice", "merchant", "date", "amount")},
        row_order="ord",
        source_file="orders",
        source_sheet="ORDERS",
        headers=HEADERS,
    )


def dirty_rules(spark: SparkSession, high_cents: int = HIGH_CENTS) -> Rules:
    """One built-in rule per segment and named vendor; the other vendors stay unmapped."""
    pairs = [
        (f"{seg} vendor {v}", category)
        for seg, category in SEGMENT_CATEGORY
        for v in range(NAMED_VENDORS)
    ]
    return rules_from_pairs(spark, pairs, "builtin", high_cents)
