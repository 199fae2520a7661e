"""Row lookups of large dictionaries, streams of folders, filters above the analysis, sizes of tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termlens.operators.vocabulary import vocabulary_from_entries


def _documents(spark, path, files: int) -> str:
    rows = [(i, f"The new york {i % 3} of the people, der newer Weg") for i in range(12)] + [(None, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_analyze", "stream_term_totals"])
def test_stream_queries_read_a_folder_of_files(spark, tmp_path, name):
    from termlens.plans.catalog import QUERIES

    sf = _documents(spark, str(tmp_path), 3)
    rows = QUERIES[name](spark, sf).collect()
    if name == "stream_analyze":
        assert len(rows) == 14 and sum(r["n_tokens"] for r in rows) == 12 * 10
    else:
        assert {(r["term"], r["frequency"], r["doc_frequency"]) for r in rows if r["category"] == "art"} == {("the", 24, 12), ("der", 12, 12)}


def test_stream_lots_are_as_wide_as_the_cluster(spark, tmp_path):
    """Every core has a file of its own in each lot."""
    import os

    from termlens.plans.catalog import QUERIES
    from termlens.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/exports"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    sf = str(tmp_path)
    rows = [(i, "the people") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    got = QUERIES["stream_term_totals"](spark, sf).where("category = 'art'").collect()
    assert [r["frequency"] for r in got] == [4000]
    (fresh,) = set(os.listdir(root)) - before
    files = [f for f in os.listdir(f"{root}/{fresh}/in") if f.startswith("part-")]
    assert len(files) == 4 * spark.sparkContext.defaultParallelism


def test_hits_are_found_in_the_row_without_a_shuffle(spark):
    """A dictionary of checked size is sent to the tasks: no n-gram is written or shuffled; the rows are those of the join."""
    from termlens.operators.matches import analyze_by_join, term_matches

    rows = [(1, "new york new york state"), (2, "Newer of the of"), (None, None), (2, ""), (3, "é o' é o' x_1 the the the")]
    df = spark.createDataFrame(rows, "id int, text string")
    v = vocabulary_from_entries(spark, {"a": ["new *", "new *", "new york*", "n*", "the the", "é o'*"], "b": ["new york state", "of the", "o *", "x_1", "the"], "none": ["zz  z", "qq"]})
    row = lambda r: repr(sorted((k, sorted(x.items()) if isinstance(x, dict) else x) for k, x in r.asDict().items()))
    for convention, n in (("tokens", 3), ("types", 5), ("tokens", 1)):
        here, joined = (analyze_by_join(df, "text", v, convention=convention, max_n=n, broadcast_limit_bytes=b) for b in (1 << 20, 0))
        assert "__tl_words" in here._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(row, here.collect())) == sorted(map(row, joined.collect()))
    here, joined = (term_matches(df, "id", "text", v, broadcast_limit_bytes=b) for b in (1 << 20, 0))
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, here.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_rows_longer_than_a_chunk(spark, monkeypatch):
    from termlens.operators import matches

    words = __import__("pyarrow").array([["a", "b"] * 5, [], ["a"], ["b", "a", "b"]])
    found = []
    for size in (1, 4, 1000):
        monkeypatch.setattr(matches, "CHUNK_TOKENS", size)
        table = __import__("pyarrow").table({"key": ["a b", "a"], "key_len": [3, 1], "is_multi": [True, False], "match_kind": ["exact", "prefix"], "category": ["c", "c"], "weight": [1, 2]})
        hits = []
        for begin, _, types, (terms, row, term, occ, entry) in matches._row_hits(matches._Dictionary(table, ["c"], [2]), words):
            hits += [(begin + int(r), terms[int(t)].as_py(), int(o), int(e)) for r, t, o, e in zip(row, term, occ, entry)]
        found.append(sorted(hits))
    assert found[0] == found[1] == found[2] == [(0, "a", 5, 1), (0, "a b", 5, 0), (2, "a", 1, 1), (3, "a", 1, 1), (3, "a b", 1, 0)]


def test_scatter_points_filter_stays_above_the_analysis(spark):
    from termlens.operators.analyze import analyze
    from termlens.operators.stats import scatter_points

    df = spark.createDataFrame([(1, "the cat", 1.0), (2, None, 2.0), (3, "x", float("nan")), (4, "the the", None)], "id int, text string, size double")
    a = analyze(df, "text", vocabulary_from_entries(spark, {"art": ["the"]}), with_detected=False)
    points = scatter_points(a, "size", "art_word_count")
    assert sorted(map(tuple, points.collect())) == [(1.0, 1), (2.0, 0)]
    plan = scatter_points(a, "n_tokens", "art_word_count")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    assert "Filter" not in below and "regexp_extract_all" not in plan[: plan.index("Generate")]


def test_balance_bounds_the_bytes_of_a_task(spark, tmp_path, monkeypatch):
    from termlens.plans import strategy

    spark.range(20_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(strategy, "TASK_BYTES", 1 << 16)
    assert strategy.balance(df, 2).rdd.getNumPartitions() >= 8


def test_numbers_are_printed_once_on_all_cores(spark, tmp_path):
    """The text of a number stands in one projection, and a small file is spread."""
    from termlens.plans.catalog import QUERIES

    rows = [(1, 1, 0.5), (1, 2, 2500.0), (2, 3, 7.9), (None, 4, None), (1, 1, -0.0)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1)
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["numbers_as_text"](spark, str(tmp_path))
    assert sorted((r["printed"], r["tokens"]) for r in got.collect()) == [("", ""), ("-0.0", "0|0"), ("2.5e-06", "2|5e|06"), ("500000000000.0", "500000000000|0"), ("7.0", "7|0")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("AS printed") == 1
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_top_ngrams_shuffle_candidates_only(spark):
    """Exact top n-grams by language; what is shuffled does not grow with the number of different n-grams."""
    import collections
    import random

    from termlens.operators import grams

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["é", "o'"]
    rows = [(rng.choice(["a", "b", None]), rng.choices(words, k=rng.randint(0, 90))) for _ in range(120)] + [("c", ["x", "y"]), ("d", None), (None, []), ("c", ["x", "x", "x", "x"])]
    df = spark.createDataFrame(rows, "category string, tk array<string>").repartition(3)
    for n, k in ((2, 25), (3, 4), (1, 3)):
        want = []
        for lang in {r[0] for r in rows}:
            found = [[" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] for g, t in rows if g == lang and t]
            total, docs = (collections.Counter(x for f in found for x in part(f)) for part in (list, set))
            best = sorted(total, key=lambda t: (-total[t], t.encode()))[:k]
            want += [(lang, i + 1, t, total[t], docs[t]) for i, t in enumerate(best)]
        for buckets in (1 << 18, 7):
            got = grams.top_ngrams(df, n, k, buckets=buckets, tokens=50)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    common = ["the"] * 40
    many = spark.createDataFrame([("a", [*common, *(f"r{j}x{i}" for i in range(2000))]) for j in range(20)], "category string, tk array<string>")
    out = grams.top_ngrams(many, 3, 1)
    assert [tuple(r) for r in out.collect()] == [("a", 1, "the the the", 760, 20)]
    assert grams.candidates(many, 3, 1).count() < 500  # of more than 40,000 different ones
