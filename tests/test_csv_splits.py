"""CSV exports give the same cells wherever Spark cuts the files."""

import csv
import io
import random
from contextlib import contextmanager

import pytest

from ledgerspark import schema as S
from ledgerspark.operators import rules
from ledgerspark.plans.clean import clean
from ledgerspark.sources import exports, headers

HEAD = ["Invoice", "Vendor", "Date", "Amount"]


@contextmanager
def split_size(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def cells(spark, path):
    rows = exports.read_exports(spark, [str(path)]).collect()
    return sorted((r.source_row, r.vals, r.problem) for r in rows if r.problem is None) or [
        (None, None, r.problem) for r in rows
    ]


def wild_export(seed, end, delimiter):
    """Records with every kind of content that a quoted field may have."""
    rng = random.Random(seed)
    parts = ["a", "é", "日", " ", "\n", "\r", "\r\n", '"', ",", ";", "\t", " ", "\x0b", "\x85", ""]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=delimiter, lineterminator=end)
    writer.writerow(HEAD)
    for _ in range(60):
        writer.writerow(["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(4)])
    return out.getvalue()


@pytest.mark.parametrize(
    ("seed", "end", "delimiter", "bom"),
    [(1, "\n", ",", b""), (2, "\r\n", ";", b"\xef\xbb\xbf"), (3, "\r", "\t", b""), (4, "\n", ";", b"")],
)
def test_records_do_not_depend_on_splits(spark, tmp_path, seed, end, delimiter, bom):
    text = wild_export(seed, end, delimiter)
    path = tmp_path / "wild.csv"
    path.write_bytes(bom + text.encode())
    want = list(enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True), 1))
    for size in (7, 41, 1 << 20):
        with split_size(spark, size):
            got = cells(spark, path)
        assert [(n, v) for n, v, _ in got] == want, size


@pytest.mark.parametrize(
    ("content", "problem"),
    [
        (b"Invoice,Vendor,Date,Amount\n1,\xff\xfe,2026-01-01,1.00\n", exports.BAD_UTF8),
        (b'Invoice,Vendor,Date,Amount\n1,"a"b,2026-01-01,1.00\n', exports.BAD_QUOTES),
        (b'Invoice,Vendor,Date,Amount\n1,"open,2026-01-01,1.00\n', exports.BAD_QUOTES),
    ],
)
def test_unreadable_files_are_refused_at_every_split_size(spark, tmp_path, content, problem):
    path = tmp_path / "bad.csv"
    path.write_bytes(content)
    for size in (9, 1 << 20):
        with split_size(spark, size):
            assert cells(spark, path) == [(None, None, problem)]
            intake = headers.map_headers(exports.read_exports(spark, [str(path)]))
            assert intake.rows.count() == 0 and intake.rejects.count() == 1


@pytest.mark.parametrize("delimiter", [";"])
@pytest.mark.parametrize("note", ["monthly export", '"a, b; c\td\n' + "more of it\n" * 40 + '"'])
def test_the_delimiter_does_not_depend_on_splits(spark, tmp_path, monkeypatch, delimiter, note):
    path = tmp_path / "late.csv"
    lines = [note, "", "x" * 90, delimiter.join(HEAD), delimiter.join(["Q1", "Pine", "2026-02-03", "12.50"]), delimiter.join(["Q2", "Oak", "2026-02-04", "3.25"])]
    path.write_text("\n".join(lines) + "\n")
    other = tmp_path / "none.csv"
    other.write_text("a;b\n" * 30)
    found = []
    for size, head in ((64, 1 << 20), (128 << 20, 1 << 20), (128 << 20, 10)):
        monkeypatch.setattr(exports, "HEAD_BYTES", head)
        with split_size(spark, size):
            cells = exports.read_exports(spark, [str(path), str(other)])
            intake = headers.map_headers(cells)
            rows = sorted((r.source_row, r.invoice_raw, r.amount_raw) for r in intake.rows.collect())
            found.append((rows, sorted((r.source_file[-8:], r.reason) for r in intake.rejects.collect())))
    assert [r[1:] for r in found[0][0]] == [("Q1", "12.50"), ("Q2", "3.25")]
    assert found[0][1] == [("none.csv", headers.UNMAPPED)]
    assert all(f == found[0] for f in found)


def test_a_bill_over_several_lines_stays_one_bill(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('Invoice,Vendor,Date,Amount\nQ1,"Pine\nand\nOak",2026-02-03,12.50\nQ2,Elm,2026-02-04,3.25\n')
    with split_size(spark, 11):
        rows = headers.map_headers(exports.read_exports(spark, [str(path)])).or_fail()
        records = clean(rows, rules.builtin_rules(spark, 250_000), hot=[]).orderBy("ord").collect()
    assert [(r.invoice_raw, r.cents, r.status) for r in records] == [("Q1", 1250, "clean"), ("Q2", 325, "clean")]
    assert records[0].merchant_raw == "Pine\nand\nOak"


def test_two_files_in_the_fixed_layout(spark, tmp_path):
    from tests.test_intake import write_workbook

    body = {4: HEAD, 5: ["F1", "Pine", "2026-02-03", "12.50"]}
    names = [name for name, _ in S.FIXED_LAYOUT]
    head = {name: wanted for name, wanted in S.FIXED_LAYOUT}
    sheets = {n: {**body, 4: head[n]} for n in names}
    files = [
        write_workbook(tmp_path / "good.xlsx", sheets),
        write_workbook(tmp_path / "also.xlsx", sheets),
        write_workbook(tmp_path / "wrong.xlsx", {**sheets, names[0]: {**body, 4: head[names[0]][::-1]}}),
    ]
    intake = headers.map_headers(exports.read_exports(spark, files), mode="fixed")
    ids = [r.id for r in intake.rows.collect()]
    assert len(ids) == len(set(ids)) == 3 * len(names) - 1
    refused = [r for r in intake.rejects.collect() if r.reason == headers.LAYOUT]
    from_wrong = [r for r in intake.rows.collect() if r.source_file.endswith("wrong.xlsx")]
    assert refused and names[0] not in {r.source_sheet for r in from_wrong}
