"""Writers: ledger tables, report tables, change log, rules and suggestions.

Nothing is overwritten: every target must be new, and must not overlap an input.
"""

import posixpath
import re
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import cents_as_amount, month_key
from ledgerspark.operators import checks
from ledgerspark.operators.changes import CHANGE_COLUMNS, build_changes, change_count, numbered_build_changes
from ledgerspark.operators.numbering import number_rows
from ledgerspark.operators.review import apply_decisions
from ledgerspark.operators.rules import Rules
from ledgerspark.operators.totals import reconcile
from ledgerspark.plans.clean import clean
from ledgerspark.plans.reports import SUMMARY_ORDER

NEW = "errorifexists"


def _plain(path: str) -> str:
    return posixpath.normpath(re.sub(r"^file:/+", "/", path))


def check_no_overlap(target: str, inputs: list[str]) -> None:
    """Refuse a target that is, contains or lies inside an input."""
    out = _plain(target)
    for source in map(_plain, inputs):
        if out == source or source.startswith(out + "/") or out.startswith(source + "/"):
            raise ValueError("output would overlap an input; choose another directory")


def _ranged(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _by_ord(df: DataFrame, *more: str) -> DataFrame:
    return _ranged(df, "ord", *more)


def in_order(rows: DataFrame) -> DataFrame:
    """Stored records or log entries, laid out in source order for what is made from them row by row.

    The ranges are found by computing ``rows`` once more, so lay out what is cheap to read and make
    entries or report lines of it afterwards: they come in order, and are not computed twice.
    """
    return _by_ord(rows, *[c for c in ("slot", "seq") if c in rows.columns])


def in_month_order(records: DataFrame) -> DataFrame:
    """Stored records by month of the bill, then in source order; ``in_order`` tells what for."""
    return _ranged(records, month_key("bill_date"), "ord")


def write_ledger(
    path: str,
    records: DataFrame,
    changes: DataFrame,
    rules: Rules,
    input_files: list[str],
    decisions: DataFrame | None = None,
    laid_out: bool = False,
) -> None:
    """Write records, changes, reconciliation, rules and run facts under ``path``.

    Records are written first; the reconciliation is computed from the written table.  With
    ``laid_out`` the changes were made from records ``in_order``, and are written as they come.
    """
    check_no_overlap(path, input_files)
    spark = records.sparkSession
    screen = [c for c in ("decided", "decided_at") if c in records.columns]
    _by_ord(records.drop(*screen)).write.mode(NEW).partitionBy("status").parquet(f"{path}/records")
    written = spark.read.parquet(f"{path}/records")
    unused = (F.col("status") == "excluded") & (F.col("rows") == 0)
    reconcile(written, with_excluded=True).filter(~unused).coalesce(1).write.mode(NEW).parquet(
        f"{path}/reconciliation"
    )
    (changes if laid_out else _by_ord(changes, "slot")).write.mode(NEW).parquet(f"{path}/changes")
    rules.df.coalesce(1).write.mode(NEW).parquet(f"{path}/rules")
    if decisions is not None:
        decisions.write.mode(NEW).json(f"{path}/decisions")
    facts = spark.createDataFrame(
        [(rules.high_cents, list(input_files))],
        "high_amount_cents bigint, input_files array<string>",
    )
    facts.coalesce(1).write.mode(NEW).json(f"{path}/run_meta")


def read_ledger_policy(spark, path: str) -> Rules:
    """The rules and limit recorded with a ledger."""
    high = spark.read.json(f"{path}/run_meta").first()["high_amount_cents"]
    return Rules(spark.read.schema(S.RULES).parquet(f"{path}/rules"), high)


def verify_ledger(path: str, rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """The verdicts ``(check, ok, detail)`` on a written ledger, made again from the source rows.

    The records must be what the recorded policy makes of the rows, with the ``decisions`` if
    there are any; the changes and the reconciliation must be those of the records.
    """
    spark = rows.sparkSession
    records = spark.read.parquet(f"{path}/records")
    changes = spark.read.schema(build_changes(records).schema).parquet(f"{path}/changes")
    again = clean(rows, read_ledger_policy(spark, path))
    if decisions is not None:
        again = apply_decisions(again, decisions)
    compared = ["id", "status", "merchant", "category", "cents", "duplicate_of", "reasons"]
    stored = spark.read.parquet(f"{path}/reconciliation")
    unused = (F.col("status") == "excluded") & (F.col("rows") == 0)
    made = reconcile(records, with_excluded=True).filter(~unused).select(stored.columns)
    return checks.check_all([
        checks.check_identity(rows, records),
        checks.check_partition(records),
        checks.check_amounts(rows, records),
        checks.check_changes_complete(changes, records),
        checks.check_same(stored, made, "reconciliation"),
        checks.check_same(records.select(compared), again.select(compared), "records"),
    ])


def write_reports(path: str, reports: dict[str, DataFrame], laid_out: Collection[str] = ()) -> None:
    """Write each report table under its name; tables with a month are partitioned by it.

    A summary is written in its reading order.  Tables named in ``laid_out`` were made from rows
    ``in_order`` (with a month: ``in_month_order``), and are written as they come.
    """
    for name, df in reports.items():
        target = f"{path}/{name}"
        if name in laid_out:
            written = df.write.mode(NEW)
            (written.partitionBy("month") if "month" in df.columns else written).parquet(target)
        elif set(SUMMARY_ORDER) <= set(df.columns):
            _ranged(df, *SUMMARY_ORDER).write.mode(NEW).parquet(target)
        elif "month" in df.columns and "ord" in df.columns:
            _ranged(df, "month", "ord").write.mode(NEW).partitionBy("month").parquet(target)
        elif "ord" in df.columns:
            tie = [c for c in ("slot", "seq") if c in df.columns]
            _by_ord(df, *tie).write.mode(NEW).parquet(target)
        else:
            df.write.mode(NEW).parquet(target)


def numbered_changes(records: DataFrame, reviewer: DataFrame | None = None) -> DataFrame:
    """Change log of records with its running number ``n``: automatic entries in source order, then
    reviewer entries in the order they were made."""
    return reduce(DataFrame.unionByName, _numbered_parts(records, reviewer))


def _numbered_parts(records: DataFrame, reviewer: DataFrame | None) -> list[DataFrame]:
    """The numbered log in parts: automatic entries, laid out by ``n``, and then those of reviewers."""
    build = numbered_build_changes(records)
    if reviewer is None:
        return [build]
    before = records.agg(F.coalesce(F.sum(change_count()), F.lit(0)).alias("n")).scalar()
    made = F.struct(F.lit(0).alias("file_ix"), F.lit(0).alias("sheet_ix"), F.col("seq").alias("source_row"))
    later = number_rows(reviewer.withColumn("_ord", F.col("ord")).withColumn("ord", made), ["id"])
    later = later.withColumn("ord", F.col("_ord")).withColumn("n", F.col("n") + before)
    return [build, later.select("n", *CHANGE_COLUMNS)]


def write_change_log_csv(path: str, records: DataFrame, reviewer: DataFrame | None = None) -> None:
    """Change log as CSV ``n,src,field,before,after,rule,who,when``, every field quoted.

    Files and their lines are in the order of ``n``.  Automatic entries are made in that order, so
    only those of reviewers are sorted.
    """
    build, *made = _numbered_parts(records, reviewer)
    made = [df.repartitionByRange("n").sortWithinPartitions("n") for df in made]
    lines = reduce(DataFrame.unionByName, [build, *made]).select(
        "n",
        F.col("id").alias("src"),
        "field",
        "before",
        "after",
        "rule",
        "who",
        F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("when"),
    )
    (
        lines.write.mode(NEW)
        .option("header", True).option("quoteAll", True).option("escape", '"')
        .option("emptyValue", "")
        # blanks at the ends of a source cell are what the log is about
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_rules(path: str, rules: Rules) -> None:
    """Reviewer rules and limit as one JSON document that ``load_rules`` reads again.

    The document is one value by definition; rules are entered by people.
    """
    reviewer = rules.df.filter(F.col("origin") == "reviewer")
    document = reviewer.agg(
        F.sort_array(F.collect_list(F.struct("alias", "category"))).alias("aliases"),
        cents_as_amount(F.lit(rules.high_cents)).cast("double").alias("high_cad"),
    )
    text = document.select(F.to_json(F.struct("aliases", "high_cad")).alias("value"))
    text.coalesce(1).write.mode(NEW).text(path)


def write_suggestions(path: str, report: DataFrame) -> None:
    """Suggestions for uncategorised merchants, one JSON object per merchant."""
    report.write.mode(NEW).option("ignoreNullFields", False).json(path)


def write_cache(path: str, cache: DataFrame) -> None:
    """Suggestion cache as a table."""
    cache.write.mode(NEW).parquet(path)
