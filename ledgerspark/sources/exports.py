"""CSV and workbook exports as one table of cells.

Files are listed and read by Spark.  A workbook is taken apart into its sheets and its shared strings,
which are decoded in tasks of their own and joined by string number.  CSV files of any size are read
as lines, in splits, and cut into records in three steps:

1. every split tells, for each delimiter and for both states in which it may be entered (between
   records or inside quotes), how it is left and how many records start in it;
2. these few numbers are chained along each file, which fixes, for each delimiter, the state and
   the first record number of every split, or the reason why the file cannot be read; the delimiter
   is the one whose first records name all fields, and where these records are not all in what the
   first split kept of its start, the splits that hold them pass them on;
3. every split decodes the records that lie within it; the two ends that belong to a record across
   splits are put together by record number.

A record ends at a line feed, a carriage return or both; all other characters are content.
"""

import csv
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import chain, groupby, islice
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.operators.skew import BROADCAST_ROWS, fits_broadcast, lookup_join
from ledgerspark.sinks.staging import stage

CHUNK_ROWS = 10_000
DELIMITERS = [",", ";", "\t"]
SHEET = ["file_ix", "sheet_ix"]
MISSING_STRING = "shared string missing from the workbook"
_CELL_SCHEMA = (
    "source_file string, file_ix int, sheet_ix int, source_sheet string, source_row bigint, "
    "vals array<string>, kinds array<string>, problem string"
)

Row = tuple[int, str, int, list, list]  # sheet_ix, sheet, row number, values, kinds


# --- decoding one file ----------------------------------------------------------------------


def _names_all_fields(values: list[str]) -> bool:
    found = {re.sub(r"[^a-z0-9]", "", v.lower()) for v in values}
    return all(found & set(aliases) for aliases in S.HEADER_ALIASES.values())


def _records(text: str, delimiter: str) -> Iterator[list[str]]:
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True)


def _has_header(head: bytes, delimiter: str) -> bool:
    """Whether one of the first records names all four fields."""
    try:
        first = islice(_records(head.decode("utf-8", "replace"), delimiter), S.HEADER_SCAN_ROWS)
        return any(map(_names_all_fields, first))
    except csv.Error:
        return False


# --- workbooks ------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


_STORED, _DEFLATED, _ENCRYPTED = 0, 8, 1
_XML_PIECE = 1 << 16
# what a damaged workbook makes the readers raise; it becomes a reject row, nothing is dropped silently
_DAMAGE = (ValueError, KeyError, AttributeError, TypeError, IndexError, ET.ParseError, zipfile.BadZipFile, zlib.error, EOFError)
STRINGS = "xl/sharedStrings.xml"


def _member(content: bytes, info: zipfile.ZipInfo) -> bytes:
    """The stored bytes of a member, as they are; they are taken apart where they are decoded."""
    if info.flag_bits & _ENCRYPTED or info.compress_type not in (_STORED, _DEFLATED):
        raise ValueError("unsupported workbook member " + info.filename)
    name, extra = struct.unpack("<HH", content[info.header_offset + 26 : info.header_offset + 30])
    start = info.header_offset + 30 + name + extra
    return content[start : start + info.compress_size]


def workbook_members(content: bytes) -> Iterator[tuple[int, str, zipfile.ZipInfo, bytes]]:
    """``(sheet_ix, sheet, member, bytes)`` of the sheets, and of the shared strings as sheet 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        members = Counter(book.namelist())
        if max(members.values(), default=0) > 1:
            raise ValueError("duplicate workbook member name")
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [
            (x.get("name"), posixpath.normpath(posixpath.join("/xl", links[x.get(f"{_DOC_REL}id")])).lstrip("/"))
            for x in ET.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")
        ]
        named = [(i, name, book.getinfo(member)) for i, (name, member) in enumerate(sheets, 1)]
        if STRINGS in members:
            named.append((0, "", book.getinfo(STRINGS)))
        for sheet_ix, name, info in named:
            yield sheet_ix, name, info, _member(content, info)


def _ended(stored: bytes, method: int, crc: int, tag: str) -> Iterator[ET.Element]:
    """Elements of one tag of a member as they end; each is emptied after its use."""
    unpack = zlib.decompressobj(-15) if method == _DEFLATED else None
    parser, check = ET.XMLPullParser(["start", "end"]), 0
    above: list[ET.Element] = []
    for at in range(0, len(stored) + _XML_PIECE, _XML_PIECE):
        piece = stored[at : at + _XML_PIECE]
        text = piece if unpack is None else unpack.decompress(piece) if piece else unpack.flush()
        check = zlib.crc32(text, check)
        parser.feed(text)
        for event, node in parser.read_events():
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if node.tag == _MAIN + tag:
                yield node
                # its parent would else keep every element that was read
                above[-1].remove(node)
    parser.close()
    if check != crc:
        raise ValueError("damaged workbook member")


def sheet_rows(stored: bytes, method: int, crc: int) -> Iterator[tuple[int, list, list]]:
    """``(row, values, kinds)`` of a sheet; the value of kind ``#`` is the number of a shared string."""
    last = 0
    for row in _ended(stored, method, crc, "row"):
        if int(row.get("r")) <= last:
            raise ValueError("rows out of order")
        last = int(row.get("r"))
        found = dict(map(_placed, row))
        width = max(found, default=-1) + 1
        cells = [found.get(i, (None, None)) for i in range(width)]
        yield last, [v for v, _ in cells], [k for _, k in cells]


def _placed(node: ET.Element) -> tuple[int, tuple[str | None, str | None]]:
    letters = node.get("r").rstrip("0123456789")
    column = reduce(lambda n, c: 26 * n + int(c, 36) - 9, letters, 0) - 1
    parts = {child.tag.removeprefix(_MAIN): child for child in node}
    if "f" in parts:
        return column, (parts["f"].text or "", "f")
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return column, ("".join(parts["is"].itertext()) if "is" in parts else "", "s")
    text = parts["v"].text if "v" in parts else None
    if text is None:
        return column, (None, None)
    if kind == "s":
        return column, (str(int(text)), "#")
    return column, (_number_text(text), "n") if kind in "nb" else (text, "s")


def _number_text(text: str) -> str:
    number = float(text)
    return str(int(number)) if number.is_integer() else str(number)


_ARROW = pa.schema(
    [
        ("source_file", pa.string()), ("file_ix", pa.int32()), ("sheet_ix", pa.int32()),
        ("source_sheet", pa.string()), ("source_row", pa.int64()),
        ("vals", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())),
        ("problem", pa.string()),
    ]
)


def _batch(path: str, file_ix: int, rows: list[Row], problem: str | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], [], []]
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(values, field.type)
            for values, field in zip(
                [[path] * n, [file_ix] * n, *columns, [problem] * n], _ARROW
            )
        ],
        schema=_ARROW,
    )


_PART_SCHEMA = (
    "source_file string, file_ix int, sheet_ix int, source_sheet string, method int, crc bigint, "
    "stored binary, problem string"
)
_PART_NAMES = ["source_file", "file_ix", "sheet_ix", "source_sheet", "method", "crc", "stored", "problem"]
_PART_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]


def _part(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _PART_KINDS, strict=True)], _PART_NAMES)


def _parts_of_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each workbook as rows of their own, still compressed."""
    for batch in batches:
        for path, file_ix, content in zip(*(batch.column(i) for i in range(3)), strict=True):
            path, file_ix = path.as_py(), file_ix.as_py()
            try:
                if posixpath.splitext(path)[1].lower() != ".xlsx":
                    raise ValueError("supported input files are .csv and .xlsx")
                for sheet_ix, name, info, stored in workbook_members(content.as_py()):
                    yield _part(path, file_ix, sheet_ix, name, info.compress_type, info.CRC, stored, None)
            except _DAMAGE as e:
                yield _part(path, file_ix, None, None, None, None, None, str(e) or type(e).__name__)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _decode_sheets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sheets, a bounded number at a time."""
    for part in _parts(batches):
        rows: list[Row] = []
        try:
            for row in sheet_rows(part["stored"], part["method"], part["crc"]):
                rows.append((part["sheet_ix"], part["source_sheet"], *row))
                if len(rows) == CHUNK_ROWS:
                    yield _batch(part["source_file"], part["file_ix"], rows)
                    rows = []
        except _DAMAGE as e:
            yield _batch(part["source_file"], part["file_ix"], [(None, None, None, None, None)], str(e) or type(e).__name__)
        if rows:
            yield _batch(part["source_file"], part["file_ix"], rows)


def _decode_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared strings of workbooks, numbered; a damaged list ends early with a problem."""
    for part in _parts(batches):
        found, number, problem = [], 0, None

        def numbered(upto: int) -> pa.RecordBatch:
            n = len(found)  # noqa: B023
            return pa.RecordBatch.from_pydict({
                "source_file": pa.array([part["source_file"]] * n, pa.string()), "file_ix": pa.array([part["file_ix"]] * n, pa.int32()),  # noqa: B023
                "no": pa.array(range(upto - n, upto), pa.int64()), "shared": pa.array(found, pa.string()),  # noqa: B023
            })

        try:
            for node in _ended(part["stored"], part["method"], part["crc"], "si"):
                found.append("".join(node.itertext()))
                number += 1
                if len(found) == CHUNK_ROWS:
                    yield numbered(number)
                    found = []
        except _DAMAGE as e:
            problem = str(e) or type(e).__name__
        yield numbered(number)
        if problem:
            yield pa.RecordBatch.from_pydict({
                "source_file": [part["source_file"]], "file_ix": pa.array([part["file_ix"]], pa.int32()),
                "no": pa.array([-1], pa.int64()), "shared": pa.array([problem], pa.string()),
            })


def _with_strings(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """Rows of sheets with the texts behind the numbers of shared strings.

    Numbers meet the strings of their file one by one, so no task holds all strings of a workbook;
    a string that very many cells share is spread over tasks.
    """
    place = [*SHEET, "source_row"]
    cells = rows.select(*place, F.posexplode(F.arrays_zip("vals", "kinds")).alias("_pos", "_cell"))
    asked = cells.filter(F.col("_cell.kinds") == "#").select(
        *place, "_pos", F.col("_cell.vals").cast("bigint").alias("no"), F.xxhash64(*place, "_pos").alias("_lane")
    )
    known = strings.filter("no >= 0").select("file_ix", "no", "shared")
    size = BROADCAST_ROWS if fits_broadcast(known) else None
    found = lookup_join(asked, known, ["file_ix", "no"], "_lane", size)
    # one sheet row's cells
    texts = found.groupBy(place).agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", F.coalesce("shared", F.lit(""))))).alias("_texts"),
        F.count_if(F.col("shared").isNull()).alias("_lost"),
    )
    here = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    joined = rows.join(texts.withColumnsRenamed({c: f"_{c}" for c in place}), reduce(Column.__and__, here), "left")
    vals = F.transform("vals", lambda v, i: F.when(F.get("kinds", i) == "#", F.try_element_at("_texts", i)).otherwise(v))
    whole = joined.withColumn("vals", F.when(F.col("_texts").isNull(), F.col("vals")).otherwise(vals)).withColumn(
        "kinds", F.transform("kinds", lambda k: F.when(k == "#", "s").otherwise(k))
    ).withColumn("problem", F.when(F.col("_lost") > 0, MISSING_STRING).otherwise(F.col("problem")))
    broken = strings.filter("no < 0").select("source_file", "file_ix", F.col("shared").alias("problem"))
    return whole.select(rows.columns).unionByName(broken, allowMissingColumns=True)


# --- CSV files in splits --------------------------------------------------------------------

BETWEEN, INSIDE = 0, 1  # states at a line start: a record starts, or a quoted field goes on
_QUOTE, _RETURN = ord('"'), ord("\r")
BOM = b"\xef\xbb\xbf"
# what a first split keeps of its start, so that most files need no second look at it; where the
# first records take more, they are read from their splits
HEAD_BYTES = 1 << 20
# what a task reads at least, where splits are smaller
TASK_BYTES = 32 << 20
SPLIT = ["key", "start"]
BAD_QUOTES = "not readable as delimited text: bad quoting"
BAD_UTF8 = "not readable as delimited text: not UTF-8"


def after_line(line: bytes, delimiter: int, state: int) -> tuple[int, int, int, bool]:
    """State after a line, the number of records that start in it, the place of the last start,
    and whether the quoting is sound."""
    starts, last, at, n = int(state == BETWEEN), 0, 0, len(line)
    if state == BETWEEN and _QUOTE not in line and _RETURN not in line:
        return BETWEEN, 1, 0, True
    if state == INSIDE and _QUOTE not in line:
        return INSIDE, 0, 0, True
    quoted = state == INSIDE
    while True:
        if not quoted and at < n and line[at] == _QUOTE:
            quoted, at = True, at + 1
        if quoted:
            close = line.find(b'"', at)
            if close < 0:
                return INSIDE, starts, last, True
            at = close + 1
            if at < n and line[at] == _QUOTE:
                at += 1
                continue
            quoted = False
            if at < n and line[at] not in (delimiter, _RETURN):
                return BETWEEN, starts, last, False
        else:
            ends = [x for x in (line.find(delimiter, at), line.find(b"\r", at)) if x >= 0]
            at = min(ends, default=n)
        if at >= n or (line[at] == _RETURN and at + 1 == n):
            return BETWEEN, starts, last, True
        if line[at] == _RETURN:
            starts, last = starts + 1, at + 1
        at += 1


def _plain_lines(delimiter: str) -> re.Pattern:
    """Lines that are one record each, whatever their number: every quoted field ends on its line."""
    field = rb'(?:"[^"\n]*+(?:""[^"\n]*+)*+"|[^"D\r\n][^D\r\n]*+)?+'
    line = rb"F(?:DF)*+\r?+\n".replace(b"F", field)
    return re.compile(rb"(?:L)*+".replace(b"L", line).replace(b"D", re.escape(delimiter.encode())))


_PLAIN = {ord(d): _plain_lines(d) for d in DELIMITERS}


def _runs(lines: list[bytes], delimiter: int, state: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """The lines in runs, ``(lines, state after, starts, place of the last start, sound)``.

    A run is one line, as ``after_line`` sees it, or many that are one record each.
    """
    text, at, i = b"\n".join(lines) + b"\n", 0, 0
    while i < len(lines):
        if state == BETWEEN:
            end = _PLAIN[delimiter].match(text, at).end()
            if end > at:
                n = text.count(b"\n", at, end)
                yield n, BETWEEN, n, 0, True
                at, i = end, i + n
                continue
        state, starts, last, sound = after_line(lines[i], delimiter, state)
        yield 1, state, starts, last, sound
        at, i = at + len(lines[i]) + 1, i + 1


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[list[bytes]]]]:
    """The lines of each split, in order and in lists; the columns before ``line`` name the split."""

    def runs():
        for batch in batches:
            if not batch.num_rows:
                continue
            # the key and the start tell splits apart
            key = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = batch.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(start) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                name = tuple(batch.column(i)[a].as_py() for i in range(batch.num_columns - 1))
                yield name, batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()

    for name, group in groupby(runs(), key=lambda r: r[0]):
        first = name[1] == 0

        def chunks(group=group, first=first):
            for _, lines in group:
                if first:
                    lines[0], first = lines[0].removeprefix(BOM), False
                yield lines

        yield name, chunks()


def _summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, start), chunks in _splits(batches):
        states = [[d, s, 0, True] for d in map(ord, DELIMITERS) for s in (BETWEEN, INSIDE)]
        # the lines in which the first records start, if one more record starts after them
        head, held, full, utf8 = bytearray(), start == 0, False, True
        for lines in chunks:
            utf8 = utf8 and all(line.isascii() or _is_utf8(line) for line in lines)
            done = 0
            while done < len(lines) and held and not full:
                line = lines[done]
                if len(head) + len(line) > HEAD_BYTES:
                    head, held = bytearray(), False
                else:
                    head += line + b"\n"
                for way in states:
                    way[1], starts, _, sound = after_line(line, way[0], way[1])
                    way[2] += starts
                    way[3] = way[3] and sound
                # a first split is entered between records
                full = full or min(way[2] for way in states[::2]) > S.HEADER_SCAN_ROWS
                done += 1
            _advance(states, lines[done:] if done else lines)
        yield pa.RecordBatch.from_pydict({
            "key": [key], "start": [start], "utf8": [utf8], "head": pa.array([bytes(head)], pa.binary()),
            "held": [held], "full": [full],
            "ends": pa.array([[w[1] for w in states]], pa.list_(pa.int32())),
            "starts": pa.array([[w[2] for w in states]], pa.list_(pa.int64())),
            "sound": [[w[3] for w in states]],
        })


def _advance(states: list[list], lines: list[bytes]) -> None:
    """Take the ways through the lines.  One with bad quoting is left where it is: a file in which it
    is taken is not read by that delimiter, so neither its end nor its starts count."""
    seen = {}
    for way in states:
        if not way[3]:
            continue
        # ways of one delimiter that are in the same state stay together
        if (way[0], way[1]) not in seen:
            state, starts, sound = way[1], 0, True
            for _, state, more, _, fine in _runs(lines, way[0], way[1]):
                starts, sound = starts + more, sound and fine
                if not sound:
                    break
            seen[way[0], way[1]] = state, starts, sound
        way[1], starts, way[3] = seen[way[0], way[1]]
        way[2] += starts


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode()
        return True
    except UnicodeDecodeError:
        return False


UNDECIDED = "undecided"
_WAYS = "key string, start bigint, delimiter string, entry int, first bigint, problem string"


def _chain(splits: pd.DataFrame) -> pd.DataFrame:
    """The entry state and first record of each split of one file, or why it cannot be read.

    Where the first records are not at hand, these are given for every delimiter (undecided).
    """
    splits = splits.sort_values("start", kind="stable")
    top = splits.iloc[0]
    readable = {}
    for i, delimiter in enumerate(DELIMITERS):
        state, record, rows, sound = BETWEEN, 1, [], True
        for ends, starts, fine in zip(splits["ends"], splits["starts"], splits["sound"], strict=True):
            rows.append((state, record))
            way = 2 * i + state
            state, record, sound = ends[way], record + starts[way], sound and fine[way]
        if sound and state == BETWEEN:
            readable[delimiter] = rows
    problem = BAD_UTF8 if not splits["utf8"].all() else None if readable else BAD_QUOTES
    if problem:
        return _unreadable(top["key"], problem)
    if not (top["held"] and (top["full"] or len(splits) == 1)):
        ways, problem = list(readable), UNDECIDED
    else:
        ways = [_choice({d: bytes(top["head"]) for d in readable})]
        if ways[0] not in readable:
            return _unreadable(top["key"], BAD_QUOTES)
    parts = []
    for delimiter in ways:
        entry, first = zip(*readable[delimiter], strict=True)
        parts.append(pd.DataFrame({
            "key": splits["key"].to_numpy(), "start": splits["start"].to_numpy(), "delimiter": delimiter,
            "entry": entry, "first": first, "problem": problem,
        }))
    return pd.concat(parts)


def _unreadable(key: str, problem: str) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "start": -1, "delimiter": "", "entry": 0, "first": 0, "problem": problem})


def _choice(heads: dict[str, bytes]) -> str:
    """The delimiter whose first records name all fields.

    Without a header row the file is still read, so that its rows can be reported.
    """
    named = [d for d in DELIMITERS if d in heads and _has_header(heads[d], d)]
    return named[0] if named else DELIMITERS[0]


def _first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and delimiter, the lines that belong to the first records of the file."""
    for (key, start, ways), chunks in _splits(batches):
        found = [[w["delimiter"], w["entry"], w["first"] - 1, []] for w in ways]
        for line in chain.from_iterable(chunks):
            for way in found:
                # numbered up to here; the line after the last needed start closes the record
                if way[2] <= S.HEADER_SCAN_ROWS:
                    way[3].append(line + b"\n")
                    way[1], starts, _, _ = after_line(line, ord(way[0]), way[1])
                    way[2] += starts
        yield pa.RecordBatch.from_pydict({
            "key": [key] * len(found), "start": pa.array([start] * len(found), pa.int64()),
            "delimiter": [w[0] for w in found], "lines": pa.array([b"".join(w[3]) for w in found], pa.binary()),
        })


def _choose(lines: pd.DataFrame) -> pd.DataFrame:
    """The delimiter of one file from the first records that its splits passed on."""
    lines = lines.sort_values("start", kind="stable")
    heads = {d: b"".join(map(bytes, own["lines"])) for d, own in lines.groupby("delimiter")}
    return pd.DataFrame({"key": lines["key"].iloc[:1], "chosen": _choice(heads), "ok": _choice(heads) in heads})


def _cells(path: str, file_ix: int, first: int, records: list[list[str]]) -> pa.RecordBatch:
    n, ends = len(records), np.cumsum([0, *map(len, records)])
    vals = pa.array(list(chain.from_iterable(records)), pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (vals, pa.repeat(pa.scalar("s"), len(vals)))]
    same = [pa.repeat(pa.scalar(v, kind), n) for v, kind in [(path, pa.string()), (file_ix, pa.int32()), (1, pa.int32()), ("CSV", pa.string())]]
    rows = pa.array(np.arange(first, first + n), pa.int64())
    return pa.RecordBatch.from_arrays([*same, rows, *lists, pa.nulls(n, pa.string())], schema=_ARROW)


_PIECES = _CELL_SCHEMA + ", piece binary, delimiter string"


def _with_piece(batch: pa.RecordBatch, piece: bytes | None, delimiter: str) -> pa.RecordBatch:
    n = len(batch)
    more = [pa.repeat(pa.scalar(piece, pa.binary()), n), pa.repeat(pa.scalar(delimiter, pa.string()), n)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "piece", "delimiter"])


def _decode_splits(batches: Iterable[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
    """Cells of the records within a split, or the pieces of records across splits.

    A piece is a row with the number of its record in ``source_row`` and the place of its split,
    to put pieces in order, in ``source_sheet``.
    """
    csv.field_size_limit(2**31 - 1)
    for (_, start, path, file_ix, delimiter, entry, first), chunks in _splits(batches):
        place = str(start).zfill(20)

        def piece(number: int, content: list[bytes], last: bool) -> Iterator[pa.RecordBatch]:
            if across:
                row = _batch(path, file_ix, [(0, place, number, None, None)])  # noqa: B023
                yield _with_piece(row, b"\n".join(content) + b"\n" * (not last), delimiter)  # noqa: B023

        def cells(content: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
            if not across:
                records = list(_records(b"\n".join(content).decode() + "\n", delimiter))  # noqa: B023
                yield _cells(path, file_ix, number, records)  # noqa: B023

        # held: lines of records numbered from ``number``; ``cut``: they end an earlier record
        state, record, held, cut = entry, first, [], entry == INSIDE
        number, begun = record - cut, (0, 0)
        for lines in chunks:
            done = 0
            for n, state, starts, last, _ in _runs(lines, ord(delimiter), state):
                if starts:
                    begun = (len(held) + n - 1, last)
                held += lines[done : done + n]
                done += n
                record += starts
                if state == BETWEEN and (cut or len(held) >= CHUNK_ROWS):
                    yield from piece(number, held, last=True) if cut else cells(held, number)
                    held, cut, number = [], False, record
        if held and state == BETWEEN:
            yield from cells(held, number)
        elif held and cut and begun == (0, 0):
            yield from piece(number, held, last=False)
        elif held:
            index, offset = begun
            before = held[:index] + ([held[index][: offset - 1]] if offset else [])
            if before:
                yield from piece(number, before, last=True) if cut else cells(before, number)
            yield from piece(record - 1, [held[index][offset:], *held[index + 1 :]], last=False)


def _join_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    """The record, or records on the same lines, that several splits hold pieces of."""
    csv.field_size_limit(2**31 - 1)
    pieces = pieces.sort_values("source_sheet", kind="stable")
    top = pieces.iloc[0]
    records = list(_records(b"".join(map(bytes, pieces["piece"])).decode(), top["delimiter"]))
    return _cells(top["source_file"], int(top["file_ix"]), int(top["source_row"]), records).to_pandas()


def _in_order(lines: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """The lines of the given splits, in order, with what ``splits`` says about them."""
    if fits_broadcast(splits):
        return lines.join(F.broadcast(splits), SPLIT).select(columns)
    numbered = lines.withColumn("place", F.monotonically_increasing_id())
    return numbered.join(splits, SPLIT).sortWithinPartitions(*SPLIT, "place").select(columns)


def _decided(lines: DataFrame, ways: DataFrame) -> DataFrame:
    """``ways`` with one delimiter per file, chosen by the first records wherever these lie."""
    last = F.lit(S.HEADER_SCAN_ROWS) + (F.col("entry") == INSIDE).cast("int")
    open_ = ways.filter(F.col("problem") == UNDECIDED)
    wanted = open_.filter(F.col("first") <= last).groupBy(SPLIT).agg(
        F.sort_array(F.collect_list(F.struct("delimiter", "entry", "first"))).alias("ways")  # one per delimiter
    )
    heads = _in_order(lines, wanted, [*SPLIT, "ways", "line"]).mapInArrow(
        _first_lines, "key string, start bigint, delimiter string, lines binary"
    )
    chosen = heads.groupBy("key").applyInPandas(_choose, "key string, chosen string, ok boolean")
    settled = open_.join(chosen, "key")
    good = settled.filter(F.col("ok") & (F.col("delimiter") == F.col("chosen"))).withColumn("problem", F.lit(None).cast("string"))
    bad = settled.filter(~F.col("ok")).groupBy("key", "path", "file_ix").agg(F.lit(1)).select(
        "path", "file_ix", "key", F.lit(-1).cast("bigint").alias("start"), F.lit("").alias("delimiter"), F.lit(0).alias("entry"),
        F.lit(0).cast("bigint").alias("first"), F.lit(BAD_QUOTES).alias("problem"),
    )
    done = ways.filter(F.col("problem").isNull() | (F.col("problem") != UNDECIDED))
    return done.unionByName(good.select(done.columns)).unionByName(bad).persist(StorageLevel.MEMORY_AND_DISK)


def _read_csv(spark: SparkSession, files: list[tuple[str, str, int]], size: int) -> DataFrame:
    places = spark.createDataFrame(files, "path string, key string, file_ix int")
    lines = spark.read.option("lineSep", "\n").text([path for path, _, _ in files]).select(
        F.col("_metadata.file_path").alias("key"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    # a task takes several splits where these are small; none is cut or put together
    lines = lines.coalesce(max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1))
    summary = (
        "key string, start bigint, utf8 boolean, head binary, held boolean, full boolean, ends array<int>, "
        "starts array<bigint>, sound array<boolean>"
    )
    # a few numbers per split, used for the problems, the size and the lines
    ways = lines.mapInArrow(_summarise, summary).groupBy("key").applyInPandas(_chain, _WAYS)
    # joined to the listing first: an equal plan over other splits must not find these rows
    ways = ways.join(places, "key").persist(StorageLevel.MEMORY_AND_DISK)
    if ways.filter(F.col("problem") == UNDECIDED).limit(1).count():
        ways = _decided(lines, ways)
    readable = ways.filter("problem is null").drop("problem")
    ordered = _in_order(lines, readable, [*SPLIT, "path", "file_ix", "delimiter", "entry", "first", "line"])
    # cells and pieces are read apart: cells are decoded once, and pieces need none
    whole = ordered.mapInArrow(partial(_decode_splits, across=False), _CELL_SCHEMA)
    across = ordered.mapInArrow(partial(_decode_splits, across=True), _PIECES).groupBy("file_ix", "source_row").applyInPandas(_join_pieces, _CELL_SCHEMA)
    null = F.lit(None)
    bad = ways.filter("problem is not null").select(
        F.col("path").alias("source_file"), "file_ix", null.cast("int").alias("sheet_ix"),
        null.cast("string").alias("source_sheet"), null.cast("bigint").alias("source_row"),
        null.cast("array<string>").alias("vals"), null.cast("array<string>").alias("kinds"), "problem",
    )
    return whole.unionByName(across).unionByName(bad)


# --- many files -----------------------------------------------------------------------------


def list_files(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, str, int]]:
    """``(path, key, bytes)`` of the files behind one glob (sorted) or several paths (in order).

    Only the listing is collected, which Spark's driver holds anyway.
    """
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        listing = spark.read.format("binaryFile").load(path).select(
            "path", F.col("_metadata.file_path").alias("key"), "length"
        )
        found += sorted(tuple(r) for r in listing.collect())
    return found


def read_exports(spark: SparkSession, paths: str | list[str], folder: str | None = None) -> DataFrame:
    """Cells of many CSV and XLSX exports.

    Sheets of workbooks are decoded once and kept in ``folder``, a new path, when it is given;
    otherwise they are decoded again for each table derived from them.

    Columns ``(source_file, file_ix, sheet_ix, source_sheet, source_row, vals, kinds,
    problem)``; a kind is ``s`` text, ``n`` number, ``f`` formula or null.  ``file_ix`` counts
    the files in order.  The same file given twice is an error.
    """
    files = list_files(spark, paths)
    if len(files) != len({f[0] for f in files}):
        raise ValueError("the same input file was supplied more than once")
    text, other = [], []
    size = sum(n for path, _, n in files if path.lower().endswith(".csv"))
    for ix, (path, key, _) in enumerate(files, 1):
        (text if path.lower().endswith(".csv") else other).append((path, key, ix))
    parts = [_read_workbooks(spark, other, folder)] if other else []
    parts += [_read_csv(spark, text, size)] if text else []
    return reduce(DataFrame.unionByName, parts)


def _read_workbooks(spark: SparkSession, files: list[tuple[str, str, int]], folder: str | None) -> DataFrame:
    """Cells of workbooks; the unit of work is a sheet, and the shared strings are a table."""
    places = spark.createDataFrame([(p, i) for p, _, i in files], "path string, file_ix int")
    if len(files) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    loaded = spark.read.format("binaryFile").load([p for p, _, _ in files])
    parts = (
        loaded.select("path", "content").join(places, "path")
        .select("path", "file_ix", "content").mapInArrow(_parts_of_files, _PART_SCHEMA)
    )
    if folder is not None:
        parts = stage(parts, f"{folder}/members")
    spread = parts.filter("problem is null").repartition("file_ix", "sheet_ix")
    rows = spread.filter("sheet_ix > 0").mapInArrow(_decode_sheets, _CELL_SCHEMA)
    strings = spread.filter("sheet_ix = 0").mapInArrow(_decode_strings, "source_file string, file_ix int, no bigint, shared string")
    if folder is not None:
        rows, strings = stage(rows, f"{folder}/rows"), stage(strings, f"{folder}/strings")
    bad = parts.filter("problem is not null").select("source_file", "file_ix", "problem")
    return _with_strings(rows, strings).unionByName(bad, allowMissingColumns=True)


def read_csv_exports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells of CSV exports; other files are reported as rejects by ``map_headers``."""
    return read_exports(spark, paths)


def read_workbooks(spark: SparkSession, paths: str | list[str], folder: str | None = None) -> DataFrame:
    """Cells of XLSX workbooks."""
    return read_exports(spark, paths, folder)
