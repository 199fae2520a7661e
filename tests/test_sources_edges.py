"""Sources and numbers at their edges: missing values, ragged rows, workbooks, white space, tails."""

from __future__ import annotations

import math
import os
import zipfile

import pytest

from termlens.functions.distributions import f_sf, pearson_p, qtukey
from termlens.operators.enhance import page, page_after
from termlens.operators.vocabulary import vocabulary_from_entries, vocabulary_from_wordlist, vocabulary_summary
from termlens.sources.datasets import read_dataset, read_wordlist


def _write(folder: str, name: str, text: str) -> str:
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _workbook(folder: str, name: str, rows: list[list]) -> str:
    def cell(v):
        if v is None:
            return "<c/>"
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return path


def test_missing_values_before_types(spark, tmpdir_path):
    path = _write(tmpdir_path, "a.csv", "id,text,score,ok\n1,null,0.5,true\n2,NA,NA,false\n3,fine,2,\n")
    df = read_dataset(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "score": "double", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, 0.5, True), (2, None, None, False), (3, "fine", 2.0, None)]
    kept = read_dataset(spark, path, na_values=False, infer=False).orderBy("id").collect()
    assert [r["text"] for r in kept] == ["null", "NA", "fine"]
    assert dict(read_dataset(spark, path, dtype={"id": "string"}, multiline=False).dtypes)["id"] == "string"


def test_short_and_long_rows(spark, tmpdir_path):
    short = read_wordlist(spark, _write(tmpdir_path, "w.csv", "DicTerm,A,B\nhappy,X\nsad,,X\n"))
    got = {(r["category"], r["key"]) for r in vocabulary_from_wordlist(short).table.collect()}
    assert got == {("A", "happy"), ("B", "sad")}
    with pytest.raises(Exception, match="more than 2 cells"):
        read_wordlist(spark, _write(tmpdir_path, "l.csv", "DicTerm,A\nhappy,X,Y\n")).collect()


def test_workbooks_by_their_own_headers(spark, tmpdir_path):
    _workbook(tmpdir_path, "a.xlsx", [["id", "text"], [1, "happy"], [2, None]])
    _workbook(tmpdir_path, "b.xlsx", [["text", "id", "more"], ["sad", 3, 2.5], ["NA", 4]])
    rows = read_dataset(spark, tmpdir_path, fmt="xlsx").orderBy("id")
    assert dict(rows.dtypes) == {"id": "bigint", "text": "string", "more": "double"}
    assert [tuple(r) for r in rows.collect()] == [(1, "happy", None), (2, None, None), (3, "sad", 2.5), (4, None, None)]


def test_white_space_outside_ascii(spark):
    terms = [("happy\u00a0", "X"), ("sad", "X\u2003"), ("new\u00a0york", "\u001fx")]
    wide = spark.createDataFrame(terms, "DicTerm string, C string")
    rows = {(r["key"], r["is_multi"]) for r in vocabulary_from_wordlist(wide).table.collect()}
    assert rows == {("happy", False), ("sad", False), ("new\u00a0york", True)}


def test_summary_lists_every_category(spark):
    v = vocabulary_from_entries(spark, {"a": ["x"], "b": []}, namespace="n")
    got = {r["category"]: (r["namespace"], r["n_terms"], r["sample_terms"]) for r in vocabulary_summary(v).collect()}
    assert got == {"n_a": ("n", 1, "x"), "n_b": ("n", 0, "")}


def test_page_after_equals_offset(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3), ("b", 0)], "g string, i int")
    whole = page(df, ["g", "i"], 0, 10).collect()
    for at in range(len(whole)):
        assert page_after(df, ["g", "i"], list(whole[at]), 2).collect() == whole[at + 1 : at + 3]
    assert page_after(df, ["g", "i"], None, 2).collect() == whole[:2]


def test_tails_at_the_edges():
    assert qtukey(0.95, 3, 1) == pytest.approx(26.976, abs=5e-3)
    assert qtukey(0.95, 3, 1e8) == pytest.approx(qtukey(0.95, 3, math.inf), abs=1e-5)
    for n in (10**8, 10**10, 10**12):
        r = 0.5 / math.sqrt(n - 2 + 0.25)
        assert pearson_p(r, n) == pytest.approx(0.6170750775, abs=2e-9)
    assert f_sf(math.inf, 2, 9) == 0.0
