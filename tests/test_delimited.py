"""Delimited files read by many tasks: rows equal to the one-task scan, whatever the splits."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from termlens.functions.text import number_text
from termlens.sources import delimited
from termlens.sources.datasets import read_dataset


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(r: random.Random) -> str:
    words = ["a", "b c", 'say "so"', "x,y", "l1\nl2", "", " pad ", '"', "é𝄞", "\n", "tab\tbed", '"q"\n"r"', "long " * 60, "n\n" * 30]
    return "".join(r.choice(words) for _ in range(r.randrange(4)))


def write(path, rows, sep=","):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        w.writerow(["id", "text", "not\nplain", "last"])
        w.writerows(rows)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0]))


@pytest.mark.parametrize("sep,fmt", [(",", "csv"), ("\t", "tsv")])
def test_one_file_by_many_tasks(spark, tmpdir_path, small_splits, sep, fmt):
    r = random.Random(7)
    for part in range(3):
        write(f"{tmpdir_path}/{part}.{fmt}", [(f"{part}-{i}", cell(r), cell(r), cell(r)) for i in range(400)], sep)
    write(f"{tmpdir_path}/one.{fmt}", [("long", "w\n" * 4000, "", "x")], sep)  # a record over many splits
    write(f"{tmpdir_path}/none.{fmt}", [], sep)
    whole = read_dataset(spark, tmpdir_path, fmt=fmt, infer=False, multiline="whole")
    split = read_dataset(spark, tmpdir_path, fmt=fmt, infer=False)
    assert whole.columns == split.columns == ["id", "text", "not\nplain", "last"]
    assert rows_of(split) == rows_of(whole) and split.count() == 1201
    used = split.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert used > 20


def test_a_header_over_several_splits(spark, tmpdir_path, small_splits):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('id,"' + "name\n" * 500 + '"\n1,one\n2,"tw\no"\n')
    got = read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False)
    assert [tuple(r) for r in rows_of(got)] == [("1", "one"), ("2", "tw\no")]


def test_lines_without_breaks_use_the_line_reader(spark, tmpdir_path, small_splits):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write("id,text\n\n" + "".join(f'{i},"a, ""{i}"""\n' for i in range(300)))
    got = read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False)
    assert "mapInArrow" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
    assert rows_of(got) == rows_of(read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False, multiline="whole"))


def test_carriage_returns_and_marks(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "wb") as f:
        f.write(b'\xef\xbb\xbf"id",text\r\n1,"a\nb"\r\n2,"c\r\nd"\r\n3,\r\n')
    got = read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False)
    assert [r[1] for r in rows_of(got)] == ["a\nb", "c\r\nd", None]


def test_quotes_outside_cells(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        f.write('id,text\n1,x"y\n2,"a\nb"\n')
    got = read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False)  # read by one task
    assert [tuple(r) for r in rows_of(got)] == [("1", 'x"y'), ("2", "a\nb")]
    with open(f"{tmpdir_path}/b.csv", "w") as f:
        f.write('id,text,n\n1,5",2\n2,"a\nb",3\n')
    with pytest.raises(Exception, match="multiline"):
        read_dataset(spark, f"{tmpdir_path}/b.csv", infer=False).collect()
    with pytest.raises(ValueError):
        read_dataset(spark, f"{tmpdir_path}/b.csv", multiline="lines")


def test_states_beyond_the_limit(spark, tmpdir_path, monkeypatch):
    write(f"{tmpdir_path}/a.csv", [("1", "a\nb", "", "")])
    monkeypatch.setattr(delimited, "BROADCAST_LIMIT_BYTES", 0)
    assert read_dataset(spark, f"{tmpdir_path}/a.csv", infer=False).collect()[0]["text"] == "a\nb"


def test_types_as_written(spark, tmpdir_path):
    columns = {
        "yes_no": ["yes", "no", "yes"], "t_f": ["t", "f", "t"], "code": ["12d", "7f", "3d"], "whole": ["1", "-2", "+3"], "gaps": ["1", "", "3"],
        "number": ["1", "2.5", "-.5e3"], "truth": ["True", "false", "TRUE"], "huge": ["1", "2", "99999999999999999999"], "date": ["2020-01-01"] * 3,
        "hex": ["0x1F", "1", "2"], "under": ["1_000", "2", "3"], "infinite": ["inf", "-Infinity", "1"], "none": ["", "NA", ""], "mixed": ["1", "true", "2"],
    }
    with open(f"{tmpdir_path}/a.csv", "w") as f:
        w = csv.writer(f)
        w.writerow(columns)
        w.writerows(zip(*columns.values()))
    df = read_dataset(spark, f"{tmpdir_path}/a.csv")
    got = dict(df.dtypes)
    want = {"whole": "bigint", "gaps": "double", "number": "double", "truth": "boolean", "infinite": "double"}
    assert got == {c: want.get(c, "string") for c in columns}
    assert [r["yes_no"] for r in df.collect()] == ["yes", "no", "yes"] and [r["code"] for r in df.collect()] == ["12d", "7f", "3d"]


def test_numbers_as_python_writes_them(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 5.0, 1e7, 1e-5, 1e16, 1e15, 123456789012345680.0, 0.0001, 0.00012, -1.5e-7, 1e22, 1e23, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 100.0, 12.5]
    values += [r.uniform(-1, 1) * 10 ** r.randrange(-30, 30) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_text("v").alias("s")).collect()
    assert [x["s"] for x in got] == [repr(v) for v in values]
