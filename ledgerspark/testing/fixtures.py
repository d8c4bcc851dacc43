"""Further fixtures derived from the given tables: decisions, cache, replies and exports."""

import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import amount_cents, norm_key
from ledgerspark.testing.dirty_bills import NAMED_VENDORS, VENDORS, dirty_table

# (place, divisor, action, after, rule_added, undo_of place) of the decisions on order k
_PLAN = [
    (1, 29, "category", "Software", None, None),
    (2, 58, "confirm", None, None, None),
    (3, 31, "confirm", None, None, None),
    (4, 62, "undo", None, None, 3),
    (5, 37, "category", "Uncategorised", None, None),
    (6, 43, "duplicate", "1:1:0", None, None),
    (7, 47, "exclude", None, None, None),
    (8, 59, "unknown", None, None, None),
    (9, 61, "category", "Rent", "rule", None),
    (10, 122, "undo", None, None, 9),
]


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer decisions on the bills of ``orders``; several may fall on one row."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")

    def name(place: int):
        return F.concat(F.lit("d-"), k.cast("string"), F.lit(f"-{place}"))

    entries = []
    for place, divisor, action, after, rule_added, undo_of in _PLAN:
        sheet = "9:9:" if action == "unknown" else "1:1:"
        entries.append(
            F.when(
                k % divisor == 0,
                F.struct(
                    (k * 20 + place).alias("seq"),
                    name(place).alias("id"),
                    F.concat(F.lit(sheet), (k * 10).cast("string")).alias("row_id"),
                    F.lit("confirm" if action == "unknown" else action).alias("action"),
                    (F.lit(after) if after else null).alias("after"),
                    null.alias("rule"),
                    (F.concat(F.lit("rule-"), k.cast("string")) if rule_added else null).alias(
                        "rule_added"
                    ),
                    (name(undo_of) if undo_of else null).alias("undo_of"),
                    F.timestamp_seconds(k * 20 + place).alias("at"),
                ),
            )
        )
    log = orders.select(F.inline(F.array_compact(F.array(*entries))))
    return log.select(S.DECISIONS.fieldNames())


def vendor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seg, v, merchant)`` of every vendor behind the bills."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    pairs = customer.select(
        F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % VENDORS).alias("v")
    ).distinct()
    return pairs.withColumn(
        "merchant", F.concat_ws(" ", "seg", F.lit("vendor"), F.col("v").cast("string"))
    )


def suggestion_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached suggestions for every second vendor without a rule."""
    names = vendor_names(spark, sf_dir).filter((F.col("v") >= NAMED_VENDORS) & (F.col("v") % 2 == 0))
    guess = F.when(F.col("v") % 4 == 0, "Supplies")
    return names.select(
        norm_key("merchant").alias("norm_key"),
        "merchant",
        guess.alias("category"),
        (F.col("v") / 100).alias("confidence"),
        F.concat(F.lit("seen in "), "seg").alias("reason"),
        F.lit("openai").alias("provider"),
        F.lit("model-1").alias("model"),
        F.lit("2025-06-01").cast("date").alias("generated"),
    )


def labelled_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with an expected category, for scoring the cache."""
    return vendor_names(spark, sf_dir).filter(F.col("v") >= NAMED_VENDORS).select(
        "merchant",
        F.lit("Supplies").alias("expected"),
        F.when(F.col("v") % 3 == 0, "keyword").otherwise("inference").alias("kind"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply text per customer, in the shapes a model answers in."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    category = F.when(k % 3 == 0, F.lit('"Rent"')).when(k % 3 == 1, F.lit('"Pets"')).otherwise("null")
    answer = F.concat(
        F.lit('[{"merchant": "'), "c_name", F.lit('", "category": '), category,
        F.lit(', "confidence": '), (k % 4 / 2).cast("string"),
        F.lit(', "reason": "see ]\\" [1] '), F.lpad(F.lit(""), 150, "x"), F.lit('"}]'),
    )
    reply = (
        F.when(k % 6 == 0, F.concat(F.lit("Result below.\n```json\n"), answer, F.lit("\n```")))
        .when(k % 6 == 1, F.concat(F.lit("Per [guideline], "), answer, F.lit(" done [2]")))
        .when(k % 6 == 2, F.concat(F.lit('{"results": '), answer, F.lit("}")))
        .when(k % 6 == 3, F.expr("substring(answer, 1, 30)"))
        .when(k % 6 == 4, F.lit("No answer is available [code 7]."))
        .otherwise(F.lit('[1, "two", {"vendor": "x"}, {"merchant": 7}]'))
    )
    return customer.withColumn("answer", answer).select(k.alias("batch_id"), reply.alias("reply"))


def work_folder(spark: SparkSession) -> str:
    """A new folder in the folder that all machines share.

    Only a local session, where all tasks see the same disk, may do without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="ledgerspark-")
    return f"{base}/{uuid.uuid4().hex}"


def csv_exports(spark: SparkSession, sf_dir: str) -> list[str]:
    """Write the messy bills as CSV exports in two layouts; returns their globs."""
    folder = work_folder(spark)
    rows = dirty_table(spark, sf_dir)
    plain = rows.filter(F.col("ord") % 2 == 0).select(
        F.col("invoice_raw").alias("Invoice"), F.col("merchant_raw").alias("Vendor"),
        F.col("date_raw").alias("Date"), F.col("amount_raw").alias("Amount"),
    )
    other = rows.filter(F.col("ord") % 2 != 0).select(
        F.lit("seen").alias("Note"), F.col("amount_raw").alias("Total CAD"),
        F.col("date_raw").alias("Invoice date"), F.col("merchant_raw").alias("Merchant name"),
        F.col("invoice_raw").alias("Bill ID"),
    )
    for name, df, sep in [("plain", plain, ","), ("other", other, ";")]:
        (
            df.write.option("header", True).option("sep", sep)
            .option("quoteAll", True).option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{name}")
        )
    return [f"{folder}/plain/*.csv", f"{folder}/other/*.csv"]


# characters of a note before the header, and files, of exports with a preamble
NOTE_CHARS = 100_000
PREAMBLE_FILES = 4


def preamble_exports(spark: SparkSession, sf_dir: str) -> str:
    """Write the messy bills as CSV files whose header comes after a long note; returns their glob."""
    folder = work_folder(spark)
    columns = {"date_raw": "Invoice date", "amount_raw": "Total CAD", "invoice_raw": "Bill ID", "merchant_raw": "Merchant name"}

    def quoted(values) -> Column:
        return F.concat_ws(";", *[F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"')) for v in values])

    note = ["one, two; three\tand"] * (NOTE_CHARS // 20)
    lines = ["Bills, all of them", '"a note', *note, 'to its end"', ";".join(columns.values())]
    file = F.col("file")
    top = spark.range(PREAMBLE_FILES).select(F.col("id").alias("file"), F.posexplode(F.array(*map(F.lit, lines))).alias("place", "value"))
    rows = dirty_table(spark, sf_dir).select(
        (F.col("ord") % PREAMBLE_FILES).alias("file"), (F.col("ord") + len(lines)).alias("place"), quoted(map(F.col, columns)).alias("value")
    )
    return _text_files(top.unionByName(rows), PREAMBLE_FILES, folder)


def _text_files(lines: DataFrame, files: int, folder: str) -> str:
    """Write ``(file, place, value)`` as one CSV file per ``file``, lines by place; their glob."""
    sorted_ = lines.repartitionByRange(files, "file").sortWithinPartitions("file", "place").select("file", "value")
    # a row is a line already: neither the delimiter nor the quote of this writer occurs in one
    writer = sorted_.write.partitionBy("file").option("sep", "\x02").option("quote", "\x01").option("escape", "\x01")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return f"{folder}/file=*/*.csv"


# headers of exports with faults: a sound one, none for the amount, two for it, and a sound one
# whose rows partly have a cell more
FAULTY_HEADERS = ["Invoice,Vendor,Date,Amount", "Invoice,Vendor,Date,Price", "Invoice,Vendor,Date,Amount,Total", "Invoice,Vendor,Date,Amount"]


def faulty_exports(spark: SparkSession, sf_dir: str) -> str:
    """Write the messy bills as CSV files, some of which cannot be imported; returns their glob."""
    k = F.floor(F.col("ord") / 10)
    file = (k % len(FAULTY_HEADERS)).alias("file")
    cells = [F.concat(F.lit('"'), c, F.lit('"')) for c in ("invoice_raw", "merchant_raw", "date_raw", "amount_raw")]
    cells += [F.when(k % 28 == 3, F.lit("paid"))]
    rows = dirty_table(spark, sf_dir).select(file, F.col("ord").alias("place"), F.concat_ws(",", *cells).alias("value"))
    top = spark.createDataFrame([(i, -1, h) for i, h in enumerate(FAULTY_HEADERS)], "file bigint, place bigint, value string")
    return _text_files(top.unionByName(rows), len(FAULTY_HEADERS), work_folder(spark))


def damaged_decisions(spark: SparkSession, sf_dir: str) -> str:
    """Write the decision log as JSON lines, some of them damaged; returns the folder."""
    folder = work_folder(spark)
    seq, undo = F.col("seq"), F.col("action") == "undo"
    broken, unknown, again, reused = (seq % n == 0 for n in (53, 59, 67, 71))
    incomplete = (seq % 61 == 0) & ~undo
    log = decision_log(spark, sf_dir)

    def line(**changed: Column) -> Column:
        return F.to_json(F.struct(*[changed.get(c, F.col(c)).alias(c) for c in log.columns]))

    whole = line()
    lines = (
        F.when(broken, F.array(F.expr("substring(line, 1, length(line) - 4)")))
        .when(unknown, F.array(line(action=F.lit("approve"))))
        .when(incomplete, F.array(line(row_id=F.lit(None).cast("string"))))
        .when(again, F.array(whole, whole))
        .when(reused, F.array(whole, line(id=F.concat("id", F.lit("-x")))))
        .otherwise(F.array(whole))
    )
    log.withColumn("line", whole).select(F.explode(lines).alias("value")).write.text(folder)
    return folder


def damaged_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suggestion cache with entries that no program should have written."""
    v = F.regexp_extract("merchant", r"\d+$", 0).cast("int")
    return suggestion_cache(spark, sf_dir).withColumns({
        "category": F.when(v == 34, "Pets").otherwise(F.col("category")),
        "confidence": F.when(v == 38, 1.5).otherwise(F.col("confidence")),
        "model": F.when(v == 36, "").otherwise(F.col("model")),
        "norm_key": F.when(v == 30, F.concat("norm_key", F.lit("x"))).otherwise(F.col("norm_key")),
    })


# bills in one workbook
BOOK_BILLS = 20_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _write_workbook(file, sheets: dict[str, list[list]], first_row: int) -> None:
    """A workbook whose texts are shared strings; numbers are number cells."""
    numbers: dict[str, int] = {}

    def cell(column: int, row: int, value) -> str:
        ref = f"{chr(65 + column)}{row}"
        if isinstance(value, str):
            return f'<c r="{ref}" t="s"><v>{numbers.setdefault(value, len(numbers))}</v></c>'
        return f'<c r="{ref}"><v>{value}</v></c>'

    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{n}">' + "".join(cell(c, n, v) for c, v in enumerate(values)) + "</row>"
                for n, values in enumerate(rows, first_row)
            )
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
        texts = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in numbers)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{texts}</sst>')


def workbook_exports(spark: SparkSession, sf_dir: str, fixed: bool = False) -> str:
    """Write the messy bills as workbooks; returns their glob.

    A free layout has a title, two sheets per workbook and accepted amounts as numbers; the fixed
    layout has the named sheets with their header rows and all cells as texts.
    """
    folder = work_folder(spark)
    sheets = S.FIXED_LAYOUT if fixed else [("Bills", None), ("More bills", None)]
    cents = amount_cents("amount_raw")
    rows = dirty_table(spark, sf_dir).select(
        F.floor(F.col("ord") / (10 * BOOK_BILLS)).alias("book"), (F.col("ord") % len(sheets)).alias("sheet"),
        "ord", "invoice_raw", "merchant_raw", "date_raw", "amount_raw", (cents / 100).alias("number"),
    )

    def write(bills: pd.DataFrame) -> pd.DataFrame:
        content = {}
        for i, (name, wanted) in enumerate(sheets):
            own = bills[bills["sheet"] == i].sort_values("ord")
            head = list(wanted) if fixed else ["Vendor", "Amount", "Invoice", "Date"]
            body = []
            for r in own.itertuples():
                if fixed:
                    body.append([r.invoice_raw, r.merchant_raw, r.date_raw, r.amount_raw])
                else:
                    amount = r.amount_raw if pd.isna(r.number) else r.number
                    body.append([r.merchant_raw, amount, r.invoice_raw, r.date_raw])
            content[name] = [head, *body] if fixed else [["Bills of the month"], head, *body]
        where, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/{int(bills['book'].iloc[0]):09d}.xlsx"
        # a repeated attempt writes the same workbook; no reader sees half of one
        part = f"{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(part) as file:
            _write_workbook(file, content, S.FIXED_HEADER_ROW if fixed else 1)
        where.move(part, name)
        return pd.DataFrame({"path": [name]})

    rows.groupBy("book").applyInPandas(write, "path string").collect()
    return f"{folder}/*.xlsx"
