"""Spreadsheet workbooks (.xlsx) as tables, read from their zip-and-XML container.

A workbook is one file of one task: its sheet is streamed out of the container
row by row (shared and inline texts, numbers, truth values, formula results and
dates by their number format) and becomes rows of texts, as a CSV export of the
sheet would hold them.  The columns of several workbooks are put together by
name, and types are inferred in one aggregate, in the order CSV inference uses.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import stored

# fixed values: number formats of dates, and of times alone, that files need not spell out
_DATE_FORMATS = {14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 34, 35, 36, 50, 51, 52, 53, 54, 55, 56, 57, 58}
_TIME_FORMATS = {18, 19, 20, 21, 32, 33, 45, 46, 47}
_ROWS = 2000  # rows of an Arrow batch


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _parts(box: zipfile.ZipFile, name: str) -> Iterator:
    if name in box.namelist():
        with box.open(name) as f:
            yield from (e for _, e in ElementTree.iterparse(f))


def _text(e) -> str:
    """Text of a string item: its plain or rich runs, without phonetic hints."""
    out = []
    for x in e:
        if _tag(x) == "t":
            out.append(x.text or "")
        elif _tag(x) == "r":
            out += [t.text or "" for t in x if _tag(t) == "t"]
    return "".join(out)


def _formats(box: zipfile.ZipFile) -> list[str]:
    """Per cell style: 'date', 'time' or ''."""
    own, out, inside = {}, [], False
    for e in _parts(box, "xl/styles.xml"):
        if _tag(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", e.get("formatCode", "").lower())
            own[int(e.get("numFmtId"))] = "date" if re.search("[dy]", code) else "time" if re.search("[hs]", code) else ""
        elif _tag(e) == "cellXfs":
            for x in e:
                i = int(x.get("numFmtId", 0))
                out.append(own.get(i, "date" if i in _DATE_FORMATS else "time" if i in _TIME_FORMATS else ""))
    return out


def _moment(value: str, kind: str, epoch: dt.datetime) -> str:
    """A serial day number as ISO text; whole days have no time."""
    at = epoch + dt.timedelta(seconds=round(float(value) * 86400))
    if kind == "time" and float(value) < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d" if at.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def _sheet_path(box: zipfile.ZipFile, sheet: str | None) -> tuple[str, dt.datetime]:
    """Part that holds the sheet (default: the first), and the workbook's day zero."""
    target = {e.get("Id"): e.get("Target") for e in _parts(box, "xl/_rels/workbook.xml.rels") if _tag(e) == "Relationship"}
    sheets, epoch = [], dt.datetime(1899, 12, 30)
    for e in _parts(box, "xl/workbook.xml"):
        if _tag(e) == "sheet":
            sheets.append((e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))))
        elif _tag(e) == "workbookPr" and e.get("date1904") in ("1", "true"):
            epoch = dt.datetime(1904, 1, 1)
    found = [r for n, r in sheets if sheet is None or n == sheet]
    if not found:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    at = target[found[0]]
    return (at[1:] if at.startswith("/") else f"xl/{at}"), epoch


def _column(reference: str) -> int:
    """0-based column of a cell reference like AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet as texts (None: empty cell); rows without any cell are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        part, epoch = _sheet_path(box, sheet)
        shared = [_text(e) for e in _parts(box, "xl/sharedStrings.xml") if _tag(e) == "si"]
        kinds = _formats(box)
        for row in _parts(box, part):
            if _tag(row) != "row":
                continue
            cells: list[str | None] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                kind, value = c.get("t", "n"), next((x.text for x in c if _tag(x) == "v"), None)
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = next((_text(x) for x in c if _tag(x) == "is"), None)
                elif kind == "b":
                    value = {"1": "true", "0": "false"}.get(value)
                elif kind == "e":  # #N/A and the like
                    value = None
                elif kind == "n" and value is not None and int(c.get("s", 0)) < len(kinds) and kinds[int(c.get("s", 0))]:
                    value = _moment(value, kinds[int(c.get("s", 0))], epoch)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value or None
            row.clear()
            if any(v is not None for v in cells):
                yield cells


def _names(header: Sequence[str | None]) -> list[str]:
    """Column names of a header row; nameless columns are _c0, _c1, ... and repeated names get their place."""
    out = [h if h is not None else f"_c{i}" for i, h in enumerate(header)]
    return [n if out.count(n) == 1 else f"{n}{i}" for i, n in enumerate(out)]


def _infer(rows: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Narrowest type that holds every text of a column: one aggregate for all of them."""
    kinds = ("int", "bigint", "double", "date", "timestamp")

    def fits(c, kind):
        x = F.col(c)
        ok = F.lower(x).isin("true", "false") if kind == "boolean" else x.try_cast(kind).isNotNull()
        if kind == "date":  # a moment can be cast to its day
            ok = ok & x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
        return F.bool_and(x.isNull() | ok)
    flags = [fits(f"v.`{c}`", k).alias(f"{i}_{k}") for i, c in enumerate(cols) for k in (*kinds, "boolean")]
    row = rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("v")).agg(
        *flags, *[F.count(f"v.`{c}`").alias(f"{i}_n") for i, c in enumerate(cols)]).first()
    return {c: next((k for k in (*kinds, "boolean") if row[f"{i}_n"] and row[f"{i}_{k}"]), "string") for i, c in enumerate(cols)}


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = False, file_col: str | None = None) -> DataFrame:
    """All rows of the workbooks at ``path`` (a file, folder or pattern), the first row of each
    sheet being its header.

    The columns are those of all workbooks, in the order of their first appearance by file name; where a
    workbook lacks one, its rows are null.  All columns are texts unless ``infer``.  ``file_col`` names a
    column with the file's path.  Headers (one list per workbook) reach the driver, cells do not."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".xlsx"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(file, head, rows):
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([head] * len(rows), pa.bool_()),
                                               pa.array(rows, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))],
                                              names=["file", "head", "cells"])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = sheet_rows(content.as_py(), sheet)
                names = _names(next(rows, []))
                yield batch(file, True, [[{"k": n, "v": None} for n in names]])
                held = []
                for r in rows:
                    names += [f"_c{i}" for i in range(len(names), len(r))]
                    held.append([{"k": n, "v": v} for n, v in zip(names, r, strict=False) if v is not None])
                    if len(held) == _ROWS:
                        yield batch(file, False, held)
                        held = []
                if held:
                    yield batch(file, False, held)
    cells = stored(files.select("path", "content").mapInArrow(parse, "file string, head boolean, cells array<struct<k: string, v: string>>"), "cells")
    order = (cells.select("file", "head", F.posexplode("cells").alias("i", "c"))
             .groupBy(F.col("c.k").alias("k")).agg(F.min(F.struct("file", (~F.col("head")).alias("late"), "i")).alias("at")).orderBy("at"))
    cols = [r.k for r in order.select("k").collect()]
    pairs = F.map_from_entries(F.col("cells"))
    rows = cells.where("NOT head").select("file", pairs.alias("m")).select(
        *([F.col("file").alias(file_col)] if file_col else []), *[F.col("m")[c].alias(c) for c in cols])
    if infer and cols:
        types = _infer(rows, cols)
        rows = rows.select(*([file_col] if file_col else []), *[F.col(f"`{c}`").cast(types[c]).alias(c) for c in cols])
    return rows


def workbook_bytes(columns: Sequence[str], rows: Iterable[Sequence], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: header and rows; numbers, truth values, dates and texts (None: no cell)."""
    def reference(i: int, j: int) -> str:
        name, j = "", j + 1
        while j:
            name, j = chr(65 + (j - 1) % 26) + name, (j - 1) // 26
        return f"{name}{i}"

    texts: dict[str, int] = {}

    def cell(at: str, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c r="{at}" s="2"><v>{(v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
        if isinstance(v, dt.date):
            return f'<c r="{at}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="s"><v>{texts.setdefault(str(v), len(texts))}</v></c>'
    body = "".join(f'<row r="{i}">' + "".join(cell(reference(i, j), v) for j, v in enumerate(r)) + "</row>"
                   for i, r in enumerate([list(columns), *rows], 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                               '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                               f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
                               f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/>'
                               f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
                               f'<Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships {links}><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {links}><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
                                      f'<Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/>'
                                      f'<Relationship Id="r3" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>",
        "xl/sharedStrings.xml": f"<sst {main}>" + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, text in parts.items():
            box.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def write_workbooks(df: DataFrame, name_col: str, root: str) -> str:
    """One workbook ``root/<name>.xlsx`` per value of ``name_col`` with the other columns; a
    workbook is written by one task and holds what a sheet can (1,048,575 rows)."""
    from pyarrow import fs
    columns = [c for c in df.columns if c != name_col]

    def save(table: pa.Table) -> pa.Table:
        store, at = (fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:")))
        name = table[name_col][0].as_py()
        if len(table) > 1_048_575:
            raise ValueError(f"{name}: more rows than a sheet holds")
        store.create_dir(at, recursive=True)
        data = workbook_bytes(columns, (tuple(r[c] for c in columns) for r in table.to_pylist()))
        with store.open_output_stream(f"{at}/{name}.xlsx") as out:
            out.write(data)
        return pa.table({"name": [name], "bytes": pa.array([len(data)], pa.int64())})
    stored(df.groupBy(name_col).applyInArrow(save, "name string, bytes bigint"), "written")
    return root
