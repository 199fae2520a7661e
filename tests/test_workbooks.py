"""Workbooks written and read again: every cell, each workbook parsed once."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from termlens.sources import xlsx
from termlens.sources.datasets import read_dataset


def test_cells_survive():
    rows = [["a", 1, 2.5, True, None], ["", -3, 1e-7, False, "x\ny\tz"], ["_x0041_ & <b> \"q\"", None, None, None, "\x01\r\n é𝄞 ￾"], [None] * 5, ["end", 0, 0.0, True, " pad "]]
    got = list(xlsx.workbook_rows(xlsx.workbook_of(["s", "i", "d", "b", "t"], iter(rows))))
    text = lambda v: None if v is None else str(v)
    assert got[0] == ["s", "i", "d", "b", "t"]
    for want, have in zip(rows, got[1:], strict=True):
        assert [text(v) for v in want] == have + [None] * (5 - len(have))


def test_letters():
    for i in (0, 25, 26, 51, 701, 702, 16383):
        assert xlsx._col_index(xlsx._col_letters(i)) == i


def test_shared_strings_and_runs():
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        ns = f'xmlns="{xlsx.MAIN[1:-1]}"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>ru</t></r><r><t>ns</t></r><rPh sb=\"0\" eb=\"1\"><t>hint</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c></row><row><c t="s"><v>1</v></c></row><row><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    assert list(xlsx.workbook_rows(content.getvalue())) == [["name"], ["runs"], [None, None, "7"]]


def test_many_workbooks(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(xlsx, "ROWS_AT_ONCE", 7)
    df = spark.range(300).select("id", F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, F.col("id") / 4).alias("score"))
    files = xlsx.to_workbooks(df, F.concat(F.lit("w"), (F.col("id") % 11).cast("string"), F.lit(".xlsx")), ["id"])
    kept = files.collect()
    assert len(kept) == 11
    back = xlsx.read_workbooks(spark.createDataFrame(kept, files.schema))
    assert sorted(tuple(r) for r in back.collect()) == sorted((str(r["id"]), r["text"], None if r["score"] is None else repr(r["score"])) for r in df.collect())
    for r in kept:
        with open(f"{tmpdir_path}/{r['path']}", "wb") as f:
            f.write(bytes(r["content"]))
    typed = read_dataset(spark, tmpdir_path, fmt="xlsx")
    assert dict(typed.dtypes) == {"id": "bigint", "text": "string", "score": "double"} and typed.count() == 300


def test_workbooks_of_different_shapes(spark):
    made = [("a.xlsx", xlsx.workbook_of(["x", "y"], iter([["1", "2"]]))), ("b.xlsx", xlsx.workbook_of(["y", "z"], iter([]))), ("c.xlsx", xlsx.workbook_of(["z", "x"], iter([["3", "4"]])))]
    got = xlsx.read_workbooks(spark.createDataFrame(made, "path string, content binary"))
    assert got.columns == ["x", "y", "z"] and sorted(map(tuple, got.collect()), key=str) == [("1", "2", None), ("4", None, "3")]
    with pytest.raises(ValueError):
        xlsx.workbook_of(["x", "x"], iter([]))
