"""Top terms by thresholds, the tabulated studentized range, bounded scatter points, running totals."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.functions.distributions import ptukey, tukey_sf_column
from termlens.operators import stats, topk
from termlens.operators.analyze import analyze
from termlens.operators.detected import corpus_term_frequencies, top_terms_per_category
from termlens.operators.vocabulary import vocabulary_from_entries


@pytest.fixture(scope="module")
def detected(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    cell = lambda: {w: r.randrange(1, 4) for w in r.choices(words, [1 / (i + 1) for i in range(400)], k=r.randrange(9))}
    rows = [(cell(), cell() if i % 3 else None, {}, {"only": 1} if i < 2 else {}) for i in range(600)]
    return spark.createDataFrame(rows, ", ".join(f"{c}_detected_words map<string,bigint>" for c in "abcd")).repartition(7)


@pytest.mark.parametrize("by", topk.MEASURES)
@pytest.mark.parametrize("held", [topk.HELD, 30])
def test_top_terms_by_threshold(detected, monkeypatch, by, held):
    monkeypatch.setattr(topk, "HELD", held)
    for n in (1, 5, 60, 1000):
        names = ["category", "rank", "term", by]
        want = sorted(map(tuple, top_terms_per_category(detected, n, by=by).select(names).collect()))
        assert sorted(map(tuple, topk.top_terms_by_threshold(detected, n, by=by).select(names).collect())) == want


def test_only_candidates_are_counted_again(spark):
    # each task has many rare terms of its own and a few that all share
    rows = spark.range(8000).repartition(4).select(F.create_map(F.concat(F.lit("rare"), F.col("id").cast("string")), F.lit(1).cast("bigint"), F.concat(F.lit("hot"), (F.col("id") % 5).cast("string")), F.lit(1).cast("bigint")).alias("x_detected_words"))
    local = topk.local_counts(topk.detected_long(rows.withColumn("r", F.lit(0)), ["r"], ["x"]), "frequency")
    assert topk.candidates(local, 5, "frequency").count() == 5
    assert local.count() > 8000
    with pytest.raises(ValueError):
        topk.top_terms_by_threshold(rows, 0)
    assert topk.top_terms_by_threshold(rows.limit(0)).collect() == []


def test_tukey_table(spark):
    r = np.random.default_rng(1)
    q = [0.0, 1e-12, 1e3, float("inf"), *r.uniform(0, 9, 60).tolist()]
    for k, df in ((60, 40.0), (200, 5000.0)):
        got = spark.createDataFrame([(x,) for x in q], "q double").select(tukey_sf_column(F.col("q"), k, df).alias("p")).collect()
        assert all(abs(g["p"] - (1 - ptukey(x, k, df) if np.isfinite(x) else 0)) < 1e-7 for g, x in zip(got, q))


def test_many_groups_as_few(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(f"g{i % 9}", r.gauss(i % 9, 4)) for i in range(300)], "g string, v double")
    few = stats.tukey_hsd(df, "g", "v").collect()
    monkeypatch.setattr(stats, "TABLE_GROUPS", 2)
    assert stats.tukey_hsd(df, "g", "v").collect() == few


def test_scatter_sample(spark):
    df = spark.range(20000).select("id", (F.col("id") % 400).alias("a"), F.when(F.col("id") % 50 != 7, F.col("id") % 17).alias("b"), F.lit(3.0).alias("flat"))
    got = stats.scatter_sample(df.repartition(5), "a", "b", "id", cells=8, per_cell=4)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, stats.scatter_sample(df.repartition(3), "a", "b", "id", cells=8, per_cell=4).collect()))
    assert 8 * 8 * 4 >= len(rows) > 100
    cells = {(r[3], r[4]): r[5] for r in rows}
    assert sum(cells.values()) == df.where("b is not null").count()
    assert stats.scatter_sample(df, "flat", "b", "id").agg(F.countDistinct("cell_x")).first()[0] == 1
    assert stats.scatter_sample(df.limit(0), "a", "b", "id").collect() == []


def test_running_totals_after_a_restart(spark, tmpdir_path):
    from termlens.streaming.incremental import read_document_stream, read_term_totals, running_term_totals

    vocab = vocabulary_from_entries(spark, {"c": ["happy", "sad*"]})
    texts = ["happy sad", "sadly happy happy", "none", None, "sad sad saddle", "happy"]
    folder, out, ckpt = (f"{tmpdir_path}/{x}" for x in ("in", "out", "ckpt"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")

    def arrive(a, b):
        docs.where(F.col("id").between(a, b)).repartition(2).write.mode("append").parquet(folder)
        stream = read_document_stream(spark, folder, max_files_per_trigger=1)
        running_term_totals(stream, "text", vocab, out, ckpt).awaitTermination()
        want = corpus_term_frequencies(analyze(docs.where(F.col("id") <= b), "text", vocab), ["c"])
        assert sorted(map(tuple, read_term_totals(spark, out).collect())) == sorted(map(tuple, want.collect()))

    arrive(0, 2)
    arrive(3, 5)  # a new query on the same checkpoint goes on with the same state


def test_correlations_of_many_columns(spark, monkeypatch):
    r = random.Random(9)
    cell = lambda c: None if r.random() < 0.1 else float("nan") if r.random() < 0.05 else 5.0 if c == 3 else 1e6 + r.gauss(0, 1) * (c + 1) if c < 6 else float(r.randrange(4))
    rows = [[cell(c) for c in range(7)] + [None, i % 2] for i in range(300)]
    names = [f"x {c}" for c in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'int' if n == 'x 8' else 'double'}" for n in names)).repartition(4)
    few = {(a, b): (c, p, n) for a, b, c, p, n in stats.correlation_pairs(df, names).collect()}
    monkeypatch.setattr(stats, "WIDE", 3)
    many = {(a, b): (c, p, n) for a, b, c, p, n in stats.correlation_pairs(df, names).collect()}
    assert few.keys() == many.keys()
    for k, (c, p, n) in few.items():
        assert many[k][2] == n and (many[k][0] is None) == (c is None), (k, few[k], many[k])
        assert c is None or abs(many[k][0] - c) < 1e-9 and abs(many[k][1] - p) < 1e-9
    assert [x[2] for x in stats.correlation_pairs(df.limit(0), names).collect()] == [None] * 36
