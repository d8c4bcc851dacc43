"""Source rows from any table: the path for large inputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import as_col, text_or_empty


def source_rows_from_table(
    df: DataFrame,
    mapping: dict[str, str | Column],
    row_order: str | Column,
    row_id: str | Column | None = None,
    source_file: str = "table",
    source_sheet: str = "TABLE",
    headers: list[str] | None = None,
    file_ix: int = 1,
    sheet_ix: int = 1,
) -> DataFrame:
    """Project a table into the source-row contract.

    ``mapping`` names the column behind each of invoice, merchant, date and amount;
    ``row_order`` is a unique integer key that gives the processing order.  Only the mapped
    columns are read.
    """
    missing = [f for f in S.FIELDS if f not in mapping]
    if missing:
        raise ValueError("mapping lacks " + ", ".join(missing))
    names = headers or [
        mapping[f] if isinstance(mapping[f], str) else f for f in S.FIELDS
    ]
    row = as_col(row_order).cast("bigint")
    ident = (
        F.concat(F.lit(f"{file_ix}:{sheet_ix}:"), row.cast("string"))
        if row_id is None
        else as_col(row_id).cast("string")
    )
    return df.select(
        ident.alias("id"),
        F.struct(
            F.lit(file_ix).cast("int").alias("file_ix"),
            F.lit(sheet_ix).cast("int").alias("sheet_ix"),
            row.alias("source_row"),
        ).alias("ord"),
        F.lit(source_file).alias("source_file"),
        F.lit(source_sheet).alias("source_sheet"),
        row.alias("source_row"),
        F.array(*[F.lit(n) for n in names]).alias("headers"),
        *[text_or_empty(mapping[f]).alias(f"{f}_raw") for f in S.FIELDS],
    )


def repeated_order_keys(rows: DataFrame) -> DataFrame:
    """Order keys that occur more than once; the contract wants none."""
    return rows.groupBy("ord").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
