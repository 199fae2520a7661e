"""Deep offsets, spreading of small inputs, display strings with white space, many group pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens.functions.text import parse_detected
from termlens.operators.enhance import page
from termlens.operators.stats import tukey_pair_statistics
from termlens.plans.strategy import balance


def test_offset_without_limit(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a.b"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("k"), F.lit("x").alias("v"), F.col("id").alias("i"))
    order = ["a.b", "k", "i"]
    whole = df.orderBy(*[f"`{c}`" for c in order]).collect()
    for offset in (1, 250, 499, 500, 700):
        assert page(df.repartition(7), order, offset).collect() == whole[offset:]
    assert page(df, order, 480, columns=order).collect() == [r[0:2] + r[3:] for r in whole[480:]]
    assert "SinglePartition" not in page(df, order, 3)._jdf.queryExecution().executedPlan().toString().split("Window")[0]


def test_balance_by_files(spark, tmp_path):
    path = str(tmp_path / "SortKey [1] {a} b")
    spark.range(20).coalesce(1).write.parquet(path)
    df = spark.read.parquet(str(tmp_path / "SortKey*"))
    assert balance(df, 4).rdd.getNumPartitions() == 4
    assert balance(df, 1).rdd.getNumPartitions() == 1  # files enough
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")  # bytes enough
        assert balance(df, 4).count() == 20
        assert "RoundRobin" not in balance(df, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    frame = spark.range(3)
    assert balance(frame) is frame  # no files


def test_display_string_white_space(spark):
    cell = " happy : 2, sad:  3 , 　, old\x1c, a: b: 1, bad: x"
    (row,) = spark.createDataFrame([(cell,)], "s string").select(parse_detected("s").alias("p")).collect()
    assert [(p["term"], p["occ"]) for p in row["p"]] == [("happy", 2), ("sad", 3), ("old", 1), ("a: b", 1)]


def test_every_group_pair_once(spark):
    df = spark.range(400).select((F.col("id") % 40).cast("string").alias("g"), (F.col("id") % 13).cast("double").alias("x"))
    pairs = tukey_pair_statistics(df, "g", "x")
    rows = [(r["group1"], r["group2"]) for r in pairs.collect()]
    groups = sorted({str(i) for i in range(40)})
    assert sorted(rows) == [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    # only the one row of totals is attached by a nested loop; the pairs meet under block keys
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert all("<" not in line for line in plan.splitlines() if "NestedLoop" in line or "Cartesian" in line)
