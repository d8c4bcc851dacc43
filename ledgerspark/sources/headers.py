"""From cells to source rows: header mapping, numeric cells and import rejects.

Header rows are recognised row by row with array functions.  What was found per sheet is then
joined back to the sheet's rows in blocks of ``BLOCK_ROWS`` rows, so one huge sheet never meets
in a single task.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import norm_key, strip_ws, text_or_empty
from ledgerspark.sinks.staging import write_by

BLOCK_ROWS = 65_536
SHEET = ["file_ix", "sheet_ix"]

UNMAPPED = "cannot map invoice, merchant, date and amount headers in first five rows"
AMBIGUOUS = "ambiguous headers: more than one column matches a required field"
FORMULA = "input formula"
OUTSIDE = "data outside header columns"
LAYOUT = "unexpected headers"
MISSING_SHEET = "missing source sheet"
COLUMNS = "input formula or unsupported columns"
NO_ROWS = "no bill rows found in the supplied files"


_PLACE = ["source_file", "source_sheet", "source_row"]


def _refuse(first) -> None:
    """Raise the error that names the first problem, if there is one."""
    if first:
        place = " / ".join(str(x) for x in (first["source_file"], first["source_sheet"]) if x)
        at = f" at row {first['source_row']}" if first["source_row"] is not None else ""
        raise ValueError(f"{place}: {first['reason']}{at}")


@dataclass(frozen=True)
class Intake:
    """Result of an import: usable source rows, everything refused, and one line per sheet.

    ``judged``, if given, has rows and rejects in one table that reads the data once: the columns
    of ``rows`` and the ``reason``, which is null for usable rows.
    """

    rows: DataFrame
    rejects: DataFrame
    sheets: DataFrame
    judged: DataFrame | None = None

    def or_fail(self, path: str | None = None) -> DataFrame:
        """The source rows, or an error naming the first problem; nothing is half imported.

        With a new folder ``path`` the rows are written there and decided on in that one pass.
        """
        if path is not None:
            return self.settle(path).rows
        first = self.rejects.orderBy(*_PLACE).limit(1).collect()
        _refuse(first[0] if first else None)
        if not self.rows.limit(1).collect():
            raise ValueError(NO_ROWS)
        return self.rows

    def settle(self, path: str, quarantine: bool = False) -> "Intake":
        """Write rows and rejects apart under the new folder ``path``, and decide while writing.

        What decides (the first problem, and whether there is any row) is observed as the lines
        are written, so nothing is read for it; both facts stay the same when a task runs again.
        Without ``quarantine`` a problem raises the error of ``or_fail``, and so do no rows.
        """
        none = F.lit(None).cast("string")
        lines = self.judged
        if lines is None:
            lines = self.rows.withColumn("reason", none).unionByName(self.rejects, allowMissingColumns=True)
        refused, problem = F.col("reason").isNotNull(), F.struct(*_PLACE, "reason")
        seen = Observation()
        watched = lines.observe(
            seen, F.min(F.when(refused, problem)).alias("first"), F.max(F.when(~refused, 1)).alias("some")
        )
        stored = write_by(watched.withColumn("refused", refused), "refused", path)
        if not quarantine:
            _refuse(seen.get["first"])
            if not seen.get["some"]:
                raise ValueError(NO_ROWS)
        rows = stored.filter("not refused").select(self.rows.columns)
        return Intake(rows, stored.filter("refused").select(self.rejects.columns), self.sheets)


def numeric_cell_text(value: Column, kind: Column) -> Column:
    """Text of an amount cell: a number exact to the cent gets two decimals, others stay."""
    number = value.try_cast("decimal(38,18)")
    rounded = number.cast("decimal(22,2)")
    # compared at full scale; a mixed comparison would drop digits first
    exact = number == rounded.cast("decimal(38,18)")
    return F.when(
        (kind == "n") & F.coalesce(exact, F.lit(False)), rounded.cast("string")
    ).otherwise(text_or_empty(value))


def _filled(value: Column, kind: Column) -> Column:
    return kind.isin("n", "f") | (strip_ws(value) != "")


def _cells() -> Column:
    return F.arrays_zip("vals", "kinds")


def _any_filled(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(_filled(c["vals"], c["kinds"]), F.lit(False)))


def _positions(test) -> Column:
    """Zero-based positions of the cells for which ``test(text, kind)`` holds."""
    hits = F.transform(
        _cells(), lambda c, i: F.when(F.coalesce(test(c["vals"], c["kinds"]), F.lit(False)), i)
    )
    return F.array_compact(hits)


def _alias_columns() -> dict[str, Column]:
    return {
        f: _positions(lambda v, k, a=aliases: (k == "s") & norm_key(v).isin(a))
        for f, aliases in S.HEADER_ALIASES.items()
    }


def _word_columns() -> dict[str, Column]:
    def test(value, kind, words):
        text = F.lower(strip_ws(value))
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        return (kind != "f") & (text != "") & hit

    return {
        f: _positions(lambda v, k, w=words: test(v, k, w)) for f, words in S.HEADER_WORDS.items()
    }


def _per_sheet(cells: DataFrame, columns: dict[str, Column], is_header: Column) -> DataFrame:
    """One line per sheet: its first header row, if any, and its extent.

    Only the first rows are searched; the extent is a plain hash aggregate over all rows.
    """
    names = [*SHEET, "source_file", "source_sheet"]
    extent = cells.groupBy(*names).agg(
        F.max("source_row").alias("last_row"), F.max(_any_filled(_cells())).alias("has_data")
    )
    top = cells.filter(F.col("source_row") <= S.HEADER_SCAN_ROWS).withColumns(
        {f"_{f}": c for f, c in columns.items()}
    )
    found = F.struct(
        F.col("source_row").alias("header_row"), F.col("vals").alias("header_vals"),
        *[F.col(f"_{f}") for f in columns],
    )
    header = top.groupBy(*SHEET).agg(
        F.min(F.when(is_header, found)).alias("h"),
        F.min_by("vals", "source_row").alias("first_vals"),
    )
    return extent.join(header, SHEET, "left")


def _with_sheet(cells: DataFrame, sheets: DataFrame, *columns: Column, how: str = "inner") -> DataFrame:
    """Rows with facts about their sheet."""
    block = F.floor(F.col("source_row") / BLOCK_ROWS)
    spread = sheets.select(
        *SHEET, *columns,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_row") / BLOCK_ROWS)))
        .alias("_block"),
    )
    return cells.withColumn("_block", block).join(spread, [*SHEET, "_block"], how).drop("_block")


def _source_rows(df: DataFrame, ident: Column, headers: Column, raw: dict, *more: Column) -> DataFrame:
    return df.select(
        ident.alias("id"),
        F.struct("file_ix", "sheet_ix", "source_row").alias("ord"),
        "source_file", "source_sheet", "source_row",
        headers.alias("headers"),
        *[c.alias(f"{f}_raw") for f, c in raw.items()],
        *more,
    )


def _reject(df: DataFrame, reason: Column | str, row: str | None = "source_row") -> DataFrame:
    return df.select(
        "source_file", "source_sheet",
        (F.col(row) if row else F.lit(None)).cast("bigint").alias("source_row"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def _readable(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("problem").isNull())


def _ident() -> Column:
    return F.concat_ws(":", "file_ix", "sheet_ix", "source_row")


def map_headers(
    cells: DataFrame,
    mode: str = "strict",
    expected: list[tuple[str, list[str]]] | None = None,
    header_row: int = S.FIXED_HEADER_ROW,
) -> Intake:
    """Map header cells to the four fields and project every data row.

    ``strict``: the first of rows 1 to 5 in which every field has a known header name.
    ``words``: headers that equal or contain a known word; the invoice column is optional.
    ``fixed``: the ``expected`` header row of each named sheet, four columns wide.
    """
    if mode == "strict":
        return _map_strict(cells)
    if mode == "words":
        return _map_words(cells)
    if mode == "fixed":
        return _map_fixed(cells, expected or S.FIXED_LAYOUT, header_row)
    raise ValueError("unknown mode " + mode)


def _map_strict(cells: DataFrame) -> Intake:
    good = _readable(cells)
    everywhere = F.lit(True)
    for f in S.FIELDS:
        everywhere = everywhere & (F.size(f"_{f}") > 0)
    sheets = _per_sheet(good, _alias_columns(), everywhere).filter("has_data")
    unique = F.lit(True)
    for f in S.FIELDS:
        unique = unique & (F.size(f"h._{f}") == 1)
    mapped = sheets.filter(F.col("h").isNotNull() & unique)
    unreadable = F.col("problem").isNotNull()
    # unreadable cells belong to no sheet that was mapped by them
    data = _with_sheet(cells, mapped, F.col("h"), how="left").filter(
        unreadable | ((F.col("source_row") > F.col("h.header_row")) & _any_filled(_cells()))
    )
    # the header may be wider than the row; nothing lies outside then
    width = F.size("h.header_vals")
    beyond = _any_filled(
        F.slice(_cells(), width + 1, F.greatest(F.size("vals") - width, F.lit(0)))
    )
    reason = (
        F.when(unreadable, F.col("problem"))
        .when(F.array_contains(F.array_compact("kinds"), "f"), FORMULA).when(beyond, OUTSIDE)
    )
    at = {f: F.get(f"h._{f}", F.lit(0)) for f in S.FIELDS}
    raw = {f: text_or_empty(F.get("vals", at[f])) for f in S.FIELDS}
    raw["amount"] = numeric_cell_text(F.get("vals", at["amount"]), F.get("kinds", at["amount"]))
    headers = F.array(*[F.get("h.header_vals", at[f]) for f in S.FIELDS])
    judged = _source_rows(data.withColumn("reason", reason), _ident(), headers, raw, F.col("reason"))
    refused = sheets.withColumn(
        "reason", F.when(F.col("h").isNull(), UNMAPPED).when(~unique, AMBIGUOUS)
    )
    of_sheets = _reject(refused.filter("reason is not null"), F.col("reason"), None)
    rows = judged.filter(F.col("reason").isNull()).drop("reason")
    rejects = _reject(judged.filter("reason is not null"), F.col("reason")).unionByName(of_sheets)
    report = sheets.select(
        "source_file", "source_sheet", (F.col("h").isNotNull() & unique).alias("ok"),
        F.coalesce("h.header_vals", "first_vals").alias("headers"),
    )
    return Intake(rows, rejects, report, judged.unionByName(of_sheets, allowMissingColumns=True))


def _map_words(cells: DataFrame) -> Intake:
    good = _readable(cells)
    first = {f: F.get(f"_{f}", F.lit(0)) for f in S.FIELDS}
    used = F.array_compact(F.array(*first.values()))
    is_header = (
        first["merchant"].isNotNull() & first["date"].isNotNull() & first["amount"].isNotNull()
        & (F.size(F.array_distinct(used)) == F.size(used))
    )
    sheets = _per_sheet(good, _word_columns(), is_header)
    mapped = sheets.filter(F.col("h").isNotNull())
    data = _with_sheet(good, mapped, F.col("h")).filter(
        F.col("source_row") > F.col("h.header_row")
    )

    def cell(field: str) -> Column:
        at = F.get(f"h._{field}", F.lit(0))
        shown = F.get("kinds", at) != "f"
        return F.coalesce(F.when(shown, F.get("vals", at)), F.lit(""))

    def header(field: str) -> Column:
        return F.coalesce(
            F.get("h.header_vals", F.get(f"h._{field}", F.lit(0))), F.lit("(none)")
        )

    number = F.concat_ws("-", F.lit("ROW"), "sheet_ix", "source_row")
    raw = {f: cell(f) for f in S.FIELDS}
    some = (raw["merchant"] != "") | (raw["date"] != "") | (raw["amount"] != "")
    raw["invoice"] = F.when(raw["invoice"] == "", number).otherwise(raw["invoice"])
    headers = F.array(*[header(f) for f in S.FIELDS])
    rows = _source_rows(data.filter(some), _ident(), headers, raw)
    counts = rows.groupBy("ord.file_ix", "ord.sheet_ix").agg(F.count("*").alias("n"))
    shown = F.filter("first_vals", lambda v: v != "")
    report = sheets.join(counts, SHEET, "left").select(
        "source_file", "source_sheet", F.col("h").isNotNull().alias("ok"),
        F.when(F.col("h").isNotNull(), headers).otherwise(shown).alias("headers"),
        F.coalesce("n", F.lit(0)).alias("rows"),
    )
    rejects = _reject(cells.filter(F.col("problem").isNotNull()), F.col("problem"))
    return Intake(rows, rejects, report)


def _map_fixed(cells: DataFrame, expected: list, header_row: int) -> Intake:
    spark = cells.sparkSession
    layout = F.broadcast(
        spark.createDataFrame(
            [(name, i, list(headers)) for i, (name, headers) in enumerate(expected, 1)],
            "source_sheet string, place int, wanted array<string>",
        )
    )
    good = _readable(cells)
    tops = good.filter(F.col("source_row") == header_row).select(
        "file_ix", "source_sheet", F.col("vals").alias("top")
    )
    present = good.select("file_ix", "source_sheet").distinct().withColumn("present", F.lit(True))
    sheets = F.array(
        *[
            F.struct(
                F.lit(name).alias("source_sheet"),
                F.array(*[F.lit(h) for h in headers]).alias("wanted"),
            )
            for name, headers in expected
        ]
    )
    files = cells.select("source_file", "file_ix").distinct()
    wanted = files.select("source_file", "file_ix", F.inline(sheets))
    found = (
        wanted.join(present, ["file_ix", "source_sheet"], "left")
        .join(tops, ["file_ix", "source_sheet"], "left")
    )
    missing = found.filter(F.col("present").isNull())
    wrong = found.filter(
        F.col("present") & ~F.coalesce(F.col("top") == F.col("wanted"), F.lit(False))
    )
    accepted = found.filter(F.coalesce(F.col("top") == F.col("wanted"), F.lit(False)))
    data = (
        good.join(layout, "source_sheet").filter(F.col("source_row") > header_row)
        .join(accepted.select("file_ix", "source_sheet"), ["file_ix", "source_sheet"], "left_semi")
    )
    bad = F.array_contains(F.array_compact("kinds"), "f") | (F.size("vals") > len(S.FIELDS))
    raw = {f: text_or_empty(F.get("vals", F.lit(i))) for i, f in enumerate(S.FIELDS)}
    # the same sheet and row of another file is another bill
    several = files.agg(F.count("*") > 1).scalar()
    ident = F.when(several, F.concat_ws(":", "file_ix", "place", "source_row")).otherwise(
        F.concat_ws(":", "place", "source_row")
    )
    ordered = data.withColumn("sheet_ix", F.col("place"))
    rows = _source_rows(ordered.filter(~bad), ident, F.col("wanted"), raw)
    rejects = (
        _reject(cells.filter(F.col("problem").isNotNull()), F.col("problem"))
        .unionByName(_reject(missing, MISSING_SHEET, None))
        .unionByName(_reject(wrong, LAYOUT, None))
        .unionByName(_reject(data.filter(bad), COLUMNS))
    )
    report = found.select(
        "source_file", "source_sheet",
        F.coalesce(F.col("top") == F.col("wanted"), F.lit(False)).alias("ok"),
        F.col("top").alias("headers"),
    )
    return Intake(rows, rejects, report)
