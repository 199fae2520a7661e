"""Wordlist rules, merge/namespacing, naming, file sources and sinks (VOC-*, FN-10/11, PRJ-2, SRC-*, SNK-*)."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from termlens.errors import MissingDicTermColumnError, NoCategoryColumnsError, UnknownCategoryError, UnsupportedFormatError
from termlens.functions.naming import sanitize_columns, sanitize_identifier, uniquify
from termlens.operators.vocabulary import (
    merge_wordlists,
    vocabulary_from_entries,
    vocabulary_from_wordlist,
    vocabulary_head_tail,
    vocabulary_summary,
)
from termlens.sources.datasets import read_dataset, read_wordlist
from termlens.sources.sinks import export


def _entries(v):
    return sorted((r["category"], r["match_kind"], r["is_multi"], r["key"], r["weight"]) for r in v.table.collect())


def test_w2_buckets(spark, w2_wide):
    v = vocabulary_from_wordlist(w2_wide)
    assert v.categories == ["Affect", "Place"]
    assert _entries(v) == [
        ("Affect", "exact", False, "happy", 1),
        ("Affect", "exact", False, "sad", 1),
        ("Affect", "prefix", False, "happ", 1),
        ("Place", "exact", True, "new york", 1),
        ("Place", "prefix", True, "new", 1),
    ]


def test_term_rules(spark):
    rows = [("Happy", "X"), ("SAD", "x"), ("  glad ", "  X  "), ("", "X"), ("   ", "X"), ("*", "X"), (None, "X"),
            ("happ**", "X"), ("un*", "X"), ("un*", "X"), ("joy", "1"), ("calm", None), ("well-being", "X")]
    wide = spark.createDataFrame(rows, "DicTerm string, C string")
    got = _entries(vocabulary_from_wordlist(wide))
    assert got == [
        ("C", "exact", False, "glad", 1),
        ("C", "exact", False, "happy", 1),
        ("C", "exact", False, "sad", 1),
        ("C", "exact", False, "well-being", 1),
        ("C", "prefix", False, "happ*", 1),
        ("C", "prefix", False, "un", 2),
    ]


def test_dicterm_by_name_and_errors(spark):
    wide = spark.createDataFrame([("X", "happy")], "Affect string, DicTerm string")
    assert _entries(vocabulary_from_wordlist(wide)) == [("Affect", "exact", False, "happy", 1)]
    with pytest.raises(MissingDicTermColumnError):
        vocabulary_from_wordlist(spark.createDataFrame([("a", "X")], "Term string, A string"))
    with pytest.raises(NoCategoryColumnsError):
        vocabulary_from_wordlist(spark.createDataFrame([("a",)], "DicTerm string"))


def test_category_names_sanitised(spark):
    wide = spark.createDataFrame([("a", "X", "X")], "DicTerm string, `Affect-Modal` string, `Place/Location` string")
    assert vocabulary_from_wordlist(wide).categories == ["Affect_Modal", "Place_Location"]
    wide = spark.createDataFrame([("a", "X", "X")], "DicTerm string, `a.b` string, `a-b` string")
    assert vocabulary_from_wordlist(wide).categories == ["a_b", "a_b_2"]


def test_merge_namespaces(spark):
    a = spark.createDataFrame([("happy", "X")], "DicTerm string, Affect string")
    b = spark.createDataFrame([("sad", "X")], "DicTerm string, Affect string")
    assert merge_wordlists([(a, "dic1.csv"), (b, "dic2.csv")]).categories == ["dic1_Affect", "dic2_Affect"]
    assert merge_wordlists([(a, "dic.csv"), (b, "dic.csv")]).categories == ["dic_Affect", "dic_Affect_2"]
    assert merge_wordlists([(a, "x.csv"), (b, "y.csv")], ["emo"]).categories == ["emo_Affect", "y_Affect"]
    assert merge_wordlists([(a, "x.csv"), (b, "y.csv")], {"x.csv": "emo"}).categories == ["emo_Affect", "y_Affect"]


def test_select_categories(spark):
    v = vocabulary_from_entries(spark, {"a": ["x"], "b": ["y"]})
    assert v.select(["b", "zzz"]).categories == ["b"]
    assert v.select(None).categories == ["a", "b"]
    with pytest.raises(UnknownCategoryError):
        v.select(["zzz"])


def test_summaries(spark):
    v = vocabulary_from_entries(spark, {"c": ["b", "a", "new york", "happ*", "happ*", "x", "y", "z", "w"], "e": ["q*"]})
    s = {r["category"]: r for r in vocabulary_summary(v).collect()}
    assert s["c"]["n_terms"] == 9 and s["c"]["sample_terms"] == "a, b, w, x, y, z, new york, happ*"
    h = {r["category"]: r["summary"] for r in vocabulary_head_tail(v).collect()}
    assert h["c"] == "**c (7 terms):** a, b, w, ... , y, z, new york;"
    assert h["e"] == "**e (0 terms):** None;"


def test_naming():
    assert sanitize_identifier("Affect.Modal!") == "Affect_Modal"
    assert sanitize_identifier("  spaced  out  ") == "spaced_out"
    assert sanitize_identifier("!!!") == "wordlist"
    assert sanitize_columns(["a.b", "a-b", "a_b"]) == ["a_b", "a_b_2", "a_b_3"]
    assert sanitize_columns([1, 2, 2]) == ["1", "2", "2_2"]
    assert uniquify("a", {"a", "a_2", "a_3"}) == "a_4"
    assert sanitize_columns(["Text", "text"]) == ["Text", "text_2"]


def test_csv_tsv_roundtrip_with_quotes(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "hello, world", 'say "hi"\nnext line'), (2, "plain", None)], "id bigint, a string, b string")
    for fmt in ("csv", "tsv"):
        out = os.path.join(tmpdir_path, fmt)
        export(df, out, fmt)
        back = read_dataset(spark, out, fmt=fmt)
        assert sorted(back.collect()) == sorted(df.collect())


def test_dataset_format_dispatch(spark, tmpdir_path):
    with pytest.raises(UnsupportedFormatError):
        read_dataset(spark, "/x/data.json")
    df = spark.createDataFrame([(1, "happy day", 0.1), (2, "sad sad night", 0.2)], "id bigint, text string, score double")
    path = os.path.join(tmpdir_path, "d.parquet")
    df.write.parquet(path)
    back = read_dataset(spark, path, usecols=["id", "text"], dtype={"id": "int"})
    assert back.columns == ["id", "text"] and back.schema["id"].dataType.simpleString() == "int"


def _write_xlsx(path, rows):
    def cell(ref, v):
        if v is None:
            return ""
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    letters = "ABCDEFGH"
    sheet_rows = "".join(
        f'<row r="{i + 1}">' + "".join(cell(f"{letters[j]}{i + 1}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)
    )
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet_rows}</sheetData></worksheet>')


def test_xlsx_wordlist_and_dataset(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "w.xlsx")
    _write_xlsx(p, [["DicTerm", "Affect", "Place"], ["happy", "X", None], ["new *", None, "X"], ["NA", "X", None]])
    wide = read_wordlist(spark, p)
    v = vocabulary_from_wordlist(wide)
    assert _entries(v) == [("Affect", "exact", False, "happy", 1), ("Place", "prefix", True, "new", 1)]
    d = os.path.join(tmpdir_path, "d.xlsx")
    _write_xlsx(d, [["id", "text"], ["1", "happy day"], ["2", "sad night"]])
    got = read_dataset(spark, d, dtype={"id": "bigint"}).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in got] == [(1, "happy day"), (2, "sad night")]


def test_wordlist_file_formats(spark, tmpdir_path):
    for suffix, sep in ((".csv", ","), (".dicx", ","), (".tsv", "\t"), (".txt", "\t"), (".dic", "\t")):
        p = os.path.join(tmpdir_path, "wl" + suffix)
        with open(p, "w") as f:
            f.write(sep.join(["DicTerm", "Affect", "Place"]) + "\n")
            f.write(sep.join(["happy", "X", ""]) + "\n")
            f.write(sep.join(["new york", "", "X"]) + "\n")
        v = vocabulary_from_wordlist(read_wordlist(spark, p))
        assert v.categories == ["Affect", "Place"], suffix
        assert _entries(v) == [("Affect", "exact", False, "happy", 1), ("Place", "exact", True, "new york", 1)]
    with pytest.raises(UnsupportedFormatError):
        read_wordlist(spark, os.path.join(tmpdir_path, "wl.json"))


def test_wildcards_in_file_order(spark, tmpdir_path):
    from termlens.operators.vocabulary import vocabulary_summary

    with open(f"{tmpdir_path}/w.csv", "w") as f:
        f.write('DicTerm,c\nzeta*,X\nbeta,X\n"alpha*",X\nnew york*,X\nzeta*,X\nmid*,\nalpha,X\n"mu*",X\nbig a*,X\n')
    wide = read_wordlist(spark, f"{tmpdir_path}/w.csv")
    got = vocabulary_summary(vocabulary_from_wordlist(wide)).collect()[0]
    assert got["sample_terms"] == "alpha, beta, zeta*, alpha*, mu*, new york*, big a*" and got["n_terms"] == 8
    frame = vocabulary_summary(vocabulary_from_wordlist(wide.drop("__tl_ordinal"))).collect()[0]
    assert frame["sample_terms"] == "alpha, beta, alpha*, mu*, zeta*, big a*, new york*"
