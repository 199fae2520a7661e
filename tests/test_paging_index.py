"""Pages by position from an index, and exports in ordered chunks."""

from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from termlens.errors import UnknownColumnError
from termlens.operators.enhance import page
from termlens.operators.paging import PageIndex, export_chunks
from termlens.sources.datasets import read_dataset


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 5 == 0, None).otherwise(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")))
    df = spark.range(1000).select(key.alias("k"), "id", F.concat(F.lit("t\n"), F.col("id").cast("string")).alias("text"), F.create_map(F.lit("a"), "id").alias("m"))
    return df.repartition(6)


def test_pages(spark, rows, tmpdir_path):
    index = PageIndex.build(rows, ["k", "id"], f"{tmpdir_path}/index", rows_per_range=64)
    assert index.n_rows == 1000 and 12 <= index.ranges.count() <= 20
    for offset, limit in ((0, 10), (500, 130), (990, 50), (1000, 5), (3, 0), (950, None), (0, None)):
        want = [r["id"] for r in page(rows, ["k", "id"], offset, limit).collect()]
        assert [r["id"] for r in index.page(offset, limit, ["id"]).collect()] == want, (offset, limit)
    again = PageIndex.open(spark, f"{tmpdir_path}/index", ["k", "id"])
    got = again.page(700, 20)
    assert got.columns == rows.columns and got.count() == 20
    # only the ranges that the page touches are read
    plan = got._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__tl_range#\d+ (?:IN \(\d+,\d+\)|= \d+)", plan)
    with pytest.raises(UnknownColumnError):
        index.page(0, 1, ["nope"])
    with pytest.raises(ValueError):
        index.page(-1, 1)
    index.remove()
    with pytest.raises(Exception):
        PageIndex.open(spark, f"{tmpdir_path}/index", ["k", "id"])


def test_equal_keys_are_split(spark):
    df = spark.range(2000).withColumn("k", F.lit(1))
    index = PageIndex.build(df, ["k"], rows_per_range=100)
    assert index.ranges.agg(F.max("n")).first()[0] < 400
    pages = [r["id"] for at in range(0, 2000, 250) for r in index.page(at, 250, ["id"]).collect()]
    assert sorted(pages) == list(range(2000))


def test_empty(spark):
    index = PageIndex.build(spark.range(0), ["id"])
    assert index.n_rows == 0 and index.page(0, 5).collect() == []


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_chunks(spark, rows, tmpdir_path, fmt):
    out = f"{tmpdir_path}/out"
    manifest = export_chunks(rows, out, ["k", "id"], 150, fmt, exclude=["m"], rows_per_range=64).orderBy("chunk").collect()
    assert [m["rows"] for m in manifest] == [150] * 6 + [100]
    want = [(r["k"], r["id"]) for r in rows.orderBy("k", "id").collect()]
    got = []
    for m in manifest:
        folder = f"{out}/chunk={m['chunk']}"
        files = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert len(files) == 1
        part = [(r["k"], int(r["id"])) for r in (read_dataset(spark, f"{folder}/{files[0]}", fmt=fmt, infer=False)).collect()]
        assert json.loads(m["first_key"]) == dict(zip("k id".split(), part[0])) and json.loads(m["last_key"]) == dict(zip("k id".split(), part[-1]))
        got += part
    assert got == want
