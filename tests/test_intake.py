import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import checks, rules, totals
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean
from ledgerspark.sources import exports, headers
from tests import sample

PLAIN = ["Invoice", "Vendor", "Date", "Amount"]


def write_csv(path, rows, delimiter=",", encoding="utf-8-sig", quoting=csv.QUOTE_MINIMAL):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding=encoding, newline="") as f:
        csv.writer(f, delimiter=delimiter, quoting=quoting).writerows(rows)
    return str(path)


def _xml_cell(ref, value):
    if value is None:
        return ""
    if isinstance(value, tuple):  # formula
        return f'<c r="{ref}"><f>{value[0]}</f><v>{value[1]}</v></c>'
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def write_workbook(path, sheets):
    """A minimal workbook; ``sheets`` maps a name to {row number: values}."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)
        )
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>',
        )
        links = "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{n}">'
                + "".join(_xml_cell(f"{chr(65 + j)}{n}", v) for j, v in enumerate(values))
                + "</row>"
                for n, values in rows.items()
            )
            z.writestr(
                f"xl/worksheets/s{i}.xml",
                f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
            )
    return str(path)


def imported(spark, *paths):
    return headers.map_headers(exports.read_exports(spark, list(paths))).or_fail()


def cleaned(spark, *paths, high=250_000):
    records = clean(imported(spark, *paths), rules.builtin_rules(spark, high), hot=[])
    return records.orderBy("ord").collect()


def test_glob_is_sorted(spark, tmp_path):
    for name in ("b", "a", "c"):
        write_csv(tmp_path / f"{name}.csv", [PLAIN, [name, "v", "2026-01-01", "1.00"]])
    rows = headers.map_headers(exports.read_csv_exports(spark, f"{tmp_path}/*.csv")).or_fail()
    got = rows.orderBy("ord").collect()
    assert [(x["id"], x["invoice_raw"]) for x in got] == [
        ("1:1:2", "a"), ("2:1:2", "b"), ("3:1:2", "c"),
    ]


def test_quoted_fields_over_lines(spark, tmp_path):
    path = write_csv(
        tmp_path / "q.csv",
        [PLAIN, ["i", "Corner\nShop", "2026-01-01", "1.00"], ["j", 'a ""b', "2026-01-01", "2"]],
        ";", "utf-8", csv.QUOTE_ALL,
    )
    r = cleaned(spark, path)
    assert [(x["merchant_raw"], x["source_row"]) for x in r] == [
        ("Corner\nShop", 2), ('a ""b', 3),
    ]


def test_tab_separated(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", [PLAIN, ["i", "a,b;c", "2026-01-01", "1,000.00"]], "\t")
    assert [x["cents"] for x in cleaned(spark, path)] == [100000]


@pytest.mark.parametrize(
    "name,rows,reason",
    [
        ("bad.csv", [["Vendor", "Amount"], ["Shop", "1.00"]], "cannot map"),
        ("two.csv", [["Invoice", "Vendor", "Merchant", "Date", "Amount"]], "ambiguous headers"),
        ("extra.csv", [PLAIN, ["i", "v", "2026-01-01", "1.00", "lost"]], "outside header"),
        ("bill.pdf", [["some other text"]], "supported input files"),
        ("late.csv", [[]] * 5 + [PLAIN, ["i", "v", "2026-01-01", "1.00"]], "cannot map"),
        ("quote.csv", [["x"]], "cannot map"),
    ],
)
def test_rejected_files(spark, tmp_path, name, rows, reason):
    path = write_csv(tmp_path / name, rows)
    with pytest.raises(ValueError, match=reason):
        imported(spark, path)


def test_quarantine_keeps_the_rest(spark, tmp_path):
    good = write_csv(
        tmp_path / "a.csv",
        [PLAIN, ["i", "v", "2026-01-01", "1.00"], ["j", "v", "2026-01-01", "1.00", "lost"]],
    )
    bad = write_csv(tmp_path / "b.csv", [["Vendor", "Amount"], ["Shop", "1.00"]])
    broken = tmp_path / "c.xlsx"
    broken.write_bytes(b"not a workbook")
    intake = headers.map_headers(exports.read_exports(spark, [good, bad, str(broken)]))
    assert [r["invoice_raw"] for r in intake.rows.collect()] == ["i"]
    found = {(r["source_row"], r["reason"]) for r in intake.rejects.collect()}
    assert found == {
        (3, headers.OUTSIDE), (None, headers.UNMAPPED), (None, "File is not a zip file"),
    }


def test_same_file_twice(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [PLAIN, ["i", "v", "2026-01-01", "1.00"]])
    with pytest.raises(ValueError, match="more than once"):
        exports.read_exports(spark, [path, path])


def test_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="no bill rows"):
        imported(spark, write_csv(tmp_path / "a.csv", [PLAIN]))


def test_no_retained_bill(spark, tmp_path):
    path = write_csv(tmp_path / "u.csv", [PLAIN, ["i", "v", "", ""]])
    records = clean(imported(spark, path), rules.builtin_rules(spark), hot=[])
    lines = {r["status"]: r for r in totals.reconcile(records).collect()}
    assert lines["clean"]["rows"] == 0 and lines["input"]["unknown_rows"] == 1
    summary = reports.report_summary(records, 250_000).collect()
    assert {r["section"] for r in summary} == {0, 2}


def test_workbook(spark, tmp_path):
    path = write_workbook(
        tmp_path / "custom.xlsx",
        {
            "Custom 0": {4: PLAIN, 5: ["i1", "Demo Software 03", "2024-12-31", 1.5],
                         6: ["i2", "Unknown", "2026-01-01", 1.999]},
            "Empty": {},
            "Custom 2": {1: PLAIN, 3: ["i3", "Unknown", "2026-01-01", 0],
                         4: [None, None, None, None], 5: [77, "Unknown", "2026-01-01", 12]},
        },
    )
    r = cleaned(spark, path)
    assert [(x["id"], x["amount_raw"], x["cents"]) for x in r] == [
        ("1:1:5", "1.50", 150), ("1:1:6", "1.999", None), ("1:3:3", "0.00", 0),
        ("1:3:5", "12.00", 1200),
    ]
    assert r[3]["invoice_raw"] == "77" and r[0]["source_sheet"] == "Custom 0"


def test_workbook_formula_is_refused(spark, tmp_path):
    path = write_workbook(
        tmp_path / "f.xlsx",
        {"S": {1: PLAIN, 2: ["x", "v", "2026-01-01", ("1+1", 2)]}},
    )
    with pytest.raises(ValueError, match="input formula at row 2"):
        imported(spark, path)


def test_workbook_member_twice_is_refused(spark, tmp_path):
    path = tmp_path / "twice.xlsx"
    with zipfile.ZipFile(path, "w") as z, pytest.warns(UserWarning):
        z.writestr("a.xml", "<a/>")
        z.writestr("a.xml", "<a/>")
    with pytest.raises(ValueError, match="duplicate workbook member"):
        imported(spark, str(path))


def test_words_mode(spark, tmp_path):
    path = write_workbook(
        tmp_path / "w.xlsx",
        {
            "One": {1: ["Supplier", "Posted", "Sum (CAD)"], 2: ["Acme", "2026-01-01", 5],
                    3: [None, None, None], 4: ["Beta", "2026-01-02", ("1+1", 2)]},
            "Other": {1: ["Foo", "Bar"], 2: ["x", "y"]},
        },
    )
    intake = headers.map_headers(exports.read_workbooks(spark, path), mode="words")
    got = [
        (r["id"], r["invoice_raw"], r["merchant_raw"], r["amount_raw"], r["headers"][0])
        for r in intake.rows.orderBy("ord").collect()
    ]
    assert got == [
        ("1:1:2", "ROW-1-2", "Acme", "5", "(none)"), ("1:1:4", "ROW-1-4", "Beta", "", "(none)"),
    ]
    report = {r["source_sheet"]: (r["ok"], r["headers"], r["rows"]) for r in intake.sheets.collect()}
    assert report == {
        "One": (True, ["(none)", "Supplier", "Posted", "Sum (CAD)"], 2),
        "Other": (False, ["Foo", "Bar"], 0),
    }


def test_fixed_layout(spark, tmp_path):
    bills = sample.bills()
    sheets = {}
    for i, (name, top) in enumerate(headers.S.FIXED_LAYOUT):
        part = bills[i * 42 : (i + 1) * 42]
        sheets[name] = {4: top, **{5 + j: row for j, row in enumerate(part)}}
    path = write_workbook(tmp_path / "demo.xlsx", sheets)
    intake = headers.map_headers(exports.read_workbooks(spark, path), mode="fixed")
    records = clean(intake.or_fail(), rules.builtin_rules(spark), hot=[])
    lines = {r["status"]: (r["rows"], int(r["cents"])) for r in totals.reconcile(records).collect()}
    assert lines["clean"] == (114, 13171127) and lines["input"] == (125, 14385281)
    assert records.filter(F.col("id") == "3:45").count() == 1
    wrong = {**sheets, "Export B": {4: PLAIN}}
    del wrong["Export C"]
    bad = headers.map_headers(
        exports.read_workbooks(spark, write_workbook(tmp_path / "bad.xlsx", wrong)), mode="fixed"
    )
    assert {r["reason"] for r in bad.rejects.collect()} == {headers.LAYOUT, headers.MISSING_SHEET}


def test_shared_strings_are_joined_by_number(spark, tmp_path, monkeypatch):
    from ledgerspark.testing import fixtures as fx

    monkeypatch.setattr(exports, "CHUNK_ROWS", 7)
    body = [[f"vendor & <{i % 5}>", 1.5 + i, f"I{i}", "2026-01-02"] for i in range(60)]
    names = {"Bills": [["Vendor", "Amount", "Invoice", "Date"], *body], "Rest": [["Vendor", "Amount", "Invoice", "Date"], ["", 2, "J", "x"]]}
    for name in ("a", "b"):
        with (tmp_path / f"{name}.xlsx").open("wb") as f:
            fx._write_workbook(f, names, 1)
    for limit in (None, 0):
        if limit == 0:  # the strings are joined by shuffle
            monkeypatch.setattr(exports, "fits_broadcast", lambda df: False)
        rows = imported(spark, f"{tmp_path}/*.xlsx").orderBy("ord").collect()
        got = [(r.merchant_raw, r.amount_raw, r.invoice_raw) for r in rows if r.source_file.endswith("b.xlsx")]
        assert got[:60] == [(f"vendor & <{i % 5}>", f"{1.5 + i:.2f}", f"I{i}") for i in range(60)]
        assert got[60:] == [("", "2.00", "J")] and len(rows) == 122


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda z: z.update({"xl/worksheets/s1.xml": z["xl/worksheets/s1.xml"][:-20]}), "unclosed token"),
        (lambda z: z.update({"xl/sharedStrings.xml": b"<sst xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'/>"}), "shared string missing"),
        (lambda z: z.pop("xl/worksheets/s1.xml"), "There is no item named"),
    ],
)
def test_damaged_workbooks_are_refused(spark, tmp_path, change, reason):
    from ledgerspark.testing import fixtures as fx

    good = tmp_path / "good.xlsx"
    with good.open("wb") as f:
        fx._write_workbook(f, {"Bills": [["Vendor", "Amount", "Invoice", "Date"], ["v", 1, "i", "2026-01-02"]]}, 1)
    with zipfile.ZipFile(good) as z:
        members = {n: z.read(n) for n in z.namelist()}
    change(members)
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    intake = headers.map_headers(exports.read_exports(spark, f"{tmp_path}/*.xlsx"))
    refused = [(r.source_file[-8:], r.reason) for r in intake.rejects.collect()]
    assert refused and all(f == "bad.xlsx" for f, _ in refused)
    assert any(reason in r for _, r in refused), refused
    # rows that stand before the damage are read; ``or_fail`` refuses them with their file
    rows = [(r.source_file[-8:], r.invoice_raw) for r in intake.rows.collect()]
    assert ("ood.xlsx", "i") in rows and {i for _, i in rows} == {"i"}
    with pytest.raises(ValueError, match="bad.xlsx"):
        intake.or_fail()
