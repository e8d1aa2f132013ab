"""Workbooks read like their CSV exports."""

import csv
import datetime as dt
import io
import zipfile

import pytest

from sensorlab.sources import results as RS
from sensorlab.sources import workbook as W
from sensorlab.sources.tables import read_by_extension

ROWS = [
    ["a & b", 1, 0.1, dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5), True, 10_000_000_000, "x,1"],
    ["quote ' and <tag>", -7, 1e-5, dt.date(1999, 12, 31), dt.datetime(2024, 1, 2, 13, 0, 1), False, 5, "2"],
    [None, 12, None, None, dt.datetime(1970, 1, 1, 0, 0, 1), None, None, "é 日本"],
    ["  lead", 0, 123456.75, dt.date(2030, 1, 1), None, True, -3, None],
]
COLUMNS = ["text", "int", "real", "day", "moment", "flag", "wide", "mixed"]


def write_csv(path, columns, rows):
    def show(v):
        return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    with open(path, "w", newline="") as f:
        w = csv.writer(f, escapechar="\\", doublequote=False)
        w.writerow(columns)
        w.writerows([[show(v) for v in r] for r in rows])


def test_workbook_reads_like_its_csv_twin(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(W.workbook_bytes(COLUMNS, ROWS))
    write_csv(tmp_path / "t.csv", COLUMNS, ROWS)
    book, twin = (read_by_extension(spark, str(tmp_path / f)) for f in ("t.xlsx", "t.csv"))
    assert book.dtypes == twin.dtypes
    assert sorted(map(str, book.collect())) == sorted(map(str, twin.collect()))


def test_result_tables(spark, tmp_path):
    """Several workbooks with other columns each: put together by name, tagged by the code in the file name."""
    (tmp_path / "1_run.xlsx").write_bytes(W.workbook_bytes(["model", "accuracy"], [["svm", 0.5], ["xgb", "n/a"]]))
    (tmp_path / "16_run.xlsx").write_bytes(W.workbook_bytes(["model", " f1 ", "accuracy"], [["mlp", 0.25, 1]]))
    got = RS.coerce_numeric(RS.read_result_tables(spark, str(tmp_path), fmt="xlsx"), ["accuracy", "f1"])
    assert got.columns == ["model", "accuracy", "f1", "dataset_code"] or sorted(got.columns) == sorted(["model", "accuracy", "f1", "dataset_code"])
    rows = sorted((r.dataset_code, r.model, r.accuracy, r.f1) for r in got.collect())
    assert rows == [("01", "svm", 0.5, None), ("01", "xgb", None, None), ("16", "mlp", 1.0, 0.25)]


def book(sheet_xml, shared="", styles="", props=""):
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}">{props}<sheets><sheet name="one" sheetId="1" r:id="a"/>'
                                      '<sheet name="two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="b" Target="worksheets/s2.xml"/><Relationship Id="a" Target="/xl/worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {main}><sheetData>{sheet_xml}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row>'
                                           "<row><c><v>4</v></c></row></sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
    return out.getvalue()


def test_cell_kinds():
    xml = ('<row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c></row>'
           '<row r="2"/><row r="5"><c r="A5" t="str"><f>A1</f><v>made</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="AB5" s="1"><v>45000.5</v></c>'
           '<c r="AC5" s="2"><v>0.25</v></c><c r="AD5" s="0"><v>1.50</v></c></row>')
    data = book(xml, "<si><t>name</t><rPh><t>no</t></rPh></si>",
                '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="[h]:mm"/></numFmts>'
                '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>')
    rows = list(W.sheet_rows(data))
    assert rows[0] == [None, "name", None, "rich"]
    assert rows[1][:2] == ["made", None] and rows[1][27:] == ["2023-03-15 12:00:00", "06:00:00", "1.50"] and len(rows) == 2
    assert list(W.sheet_rows(data, "two")) == [["h"], ["4"]]
    with pytest.raises(ValueError):
        list(W.sheet_rows(data, "three"))
    early = book('<row><c><v>1</v></c></row>', props='<workbookPr date1904="1"/>')
    assert list(W.sheet_rows(early)) == [["1"]]
    assert W._names([None, "a", "b", "a"]) == ["_c0", "a1", "b", "a3"]


def test_empty_workbook(spark, tmp_path):
    (tmp_path / "e.xlsx").write_bytes(W.workbook_bytes(["a", "b"], []))
    got = read_by_extension(spark, str(tmp_path / "e.xlsx"))
    assert got.columns == ["a", "b"] and got.count() == 0
