"""``.xlsx`` workbooks (SRC-3, re-aimed to many of them): read, each parsed once, and written.

``binaryFile`` gives one row per workbook; Spark packs them into tasks of at most a split's bytes (a
larger workbook makes its own), so a task holds a bounded number of them.  Each is parsed once, as a
stream of XML events: its rows leave in batches, with the header of their workbook, and are written to
the shared folder.  The columns are those of all headers, in path order (only the distinct headers
reach the driver); a workbook without one gives nulls.  Legacy binary ``.xls`` is not supported.

:func:`to_workbooks` makes one workbook of the rows of each name, on the executors.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.errors import UnsupportedFormatError
from termlens.session import stage_table

# Names of the format's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_NS = {"m": MAIN[1:-1]}
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576  # of a sheet

ROWS_AT_ONCE = 2_000
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNCODED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\r\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _col_letters(index: int) -> str:
    out = ""
    while index >= 0:
        index, last = divmod(index, 26)
        out, index = chr(65 + last) + out, index - 1
    return out


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    try:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        sheet = wb.find("m:sheets/m:sheet", _NS)
        rid = sheet.get(f"{{{RELATION}}}id") if sheet is not None else None
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for rel in rels:
            if rel.get("Id") == rid:
                target = rel.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else "xl/" + target
    except KeyError:
        pass
    return "xl/worksheets/sheet1.xml"


def _text(element: ET.Element) -> str:
    """The text of an item: its own and that of its runs, without phonetic hints."""
    found = [t.text or "" for t in element.findall("m:t", _NS)] + [t.text or "" for t in element.findall("m:r/m:t", _NS)]
    return _CODED.sub(lambda m: chr(int(m[1], 16)), "".join(found))


def _elements(z: zipfile.ZipFile, part: str, name: str) -> Iterator[ET.Element]:
    """The elements of one name, each cleared once it was used."""
    with z.open(part) as f:
        events = ET.iterparse(f, events=("start", "end"))
        _, root = next(events)
        parents = [root]
        for event, element in events:
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == MAIN + name:
                yield element
                if parents:
                    parents[-1].remove(element)


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """First sheet of an .xlsx as rows of cell strings (missing cells -> None), one at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(si) for si in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        for row in _elements(z, _first_sheet_path(z), "row"):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", _NS):
                ref = _CELL_REF.match(c.get("r", ""))
                index = _col_index(ref.group(1)) if ref else len(cells)
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    inline = c.find("m:is", _NS)
                    cells[index] = _text(inline) if inline is not None else None
                elif v is None or v.text is None:
                    cells[index] = None
                elif kind == "s":
                    cells[index] = shared[int(v.text)]
                elif kind == "b":
                    cells[index] = "True" if v.text == "1" else "False"
                else:
                    cells[index] = v.text
            yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, names, cells) of every row; one row without cells for each header."""
    lists = pa.list_(pa.string())
    schema = pa.schema([("path", pa.string()), ("names", lists), ("cells", lists)])

    def batch_of(path: str, names: list[str], rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([names] * len(rows), lists), pa.array(rows, lists)], schema=schema)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = workbook_rows(content.as_py())
            head = next(rows, None)
            if head is None:
                continue
            names = [n if n is not None else f"col{i}" for i, n in enumerate(head)]
            held: list = [None]
            for cells in rows:
                if len(cells) > len(names):  # cells beyond the header get columns of their own
                    names = names + [f"col{i}" for i in range(len(names), len(cells))]
                    yield batch_of(path, names, [None])
                held.append(cells)
                if len(held) >= ROWS_AT_ONCE:
                    yield batch_of(path, names, held)
                    held = []
            if held:
                yield batch_of(path, names, held)


def read_workbooks(files: DataFrame) -> DataFrame:
    """The first sheets of workbooks given as (path, content) -> one DataFrame of string columns."""
    rows = stage_table(files.select("path", "content").mapInArrow(_parse, "path string, names array<string>, cells array<string>"), "workbooks")
    headers = rows.where(F.col("cells").isNull()).groupBy("names").agg(F.min("path").alias("path")).orderBy("path", F.size("names"))
    names = list(dict.fromkeys(n for row in headers.collect() for n in row["names"]))
    if not names:
        raise UnsupportedFormatError("no .xlsx workbook with a header row")
    at = [F.array_position("names", F.lit(n)).cast("int") for n in names]
    return rows.where(F.col("cells").isNotNull()).select(*[F.when(i > 0, F.get("cells", i - 1)).alias(n) for i, n in zip(at, names)])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All workbooks under ``path`` (file, folder or glob) -> one DataFrame of string columns."""
    return read_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))


def _xml(value: str) -> str:
    return escape(_UNCODED.sub(lambda m: f"_x{ord(m[0]):04X}_", value))


def workbook_of(names: list[str], rows: Iterator[list]) -> bytes:
    """A workbook with one sheet: text, numbers and truth values; missing cells are left out."""
    if len(names) != len(set(names)):
        raise ValueError(f"column names must differ: {names}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        )
        relation = '<Relationships xmlns="%s/relationships"><Relationship Id="r1" Type="%s/%s" Target="%s"/></Relationships>'
        z.writestr("_rels/.rels", relation % (PACKAGE, RELATION, "officeDocument", "xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", relation % (PACKAGE, RELATION, "worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            letters = [_col_letters(i) for i in range(len(names))]
            for nth, row in enumerate(itertools.chain([names], rows), 1):
                if nth > MOST_ROWS:
                    raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
                cells = []
                for letter, v in zip(letters, row):
                    if isinstance(v, bool):
                        cells.append(f'<c r="{letter}{nth}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, (int, float)):
                        cells.append(f'<c r="{letter}{nth}"><v>{v!r}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{letter}{nth}" t="inlineStr"><is><t xml:space="preserve">{_xml(str(v))}</t></is></c>')
                f.write(f'<row r="{nth}">{"".join(cells)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def to_workbooks(df: DataFrame, name: Column, order_by: list[str]) -> DataFrame:
    """(path, content): one workbook for each value of ``name`` with its rows in key order.

    A name must not hold more rows than a sheet; give names that split large groups.
    """
    names = df.columns
    rows = df.select(name.cast("string").alias("__path"), *[F.col(f"`{c}`") for c in names])

    def run(key, group):
        group = group.drop_columns(["__path"]).sort_by([(c, "ascending") for c in order_by])
        content = workbook_of(names, (list(r.values()) for batch in group.to_batches(1000) for r in batch.to_pylist()))
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return rows.groupBy("__path").applyInArrow(run, "path string, content binary")
