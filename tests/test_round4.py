"""the dictionary match tests each token once; task counts are summed a few times only."""

import collections
import itertools
import re

import pyarrow as pa

from termlens.functions.text import with_run_length
from termlens.operators import analyze as analysis
from termlens.operators import topk
from termlens.operators.analyze import analyze
from termlens.operators.detected import detected_long
from termlens.operators.vocabulary import vocabulary_from_entries

LISTS = {
    "few": {"x": ["a", "de", "de*", "d*", "un"], "y": ["a b", "de l*", "the *", "b a b", "d*"], "z": ["q*"]},
    "many": {"x": [f"{c}{d}*" for c in "abdeu" for d in "aeiou"] + ["a"], "y": ["a b", "ab *", "de l*"]},
}
TEXTS = ["", None, "a", "a b a b", "de la the a then b a b", "the", "thea b un une de", "d de DE l'eau ab a", "ba be bi a b ab ba de le"]


def _want(text, entries, max_n=3):
    tokens = re.findall(r"[a-z']+", (text or "").lower())
    terms = collections.Counter(" ".join(tokens[i : i + n]) for n in range(1, max_n + 1) for i in range(len(tokens) - n + 1))
    found, total = {}, 0
    for term, n in terms.items():
        weight = 0
        for e in entries:
            key, prefix, multi = e.rstrip("*").strip(), e.endswith("*"), " " in e
            if multi == (" " in term) and (term.startswith(key) if prefix else term == key):
                weight += 1
        if weight:
            found[term], total = n, total + n * weight
    return total, found


def test_matches_are_those_of_every_entry_at_every_position(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for lists in LISTS.values():
        got = {r["id"]: r for r in analyze(rows, "text", vocabulary_from_entries(spark, lists)).collect()}
        for (i, text), (name, entries) in itertools.product(enumerate(TEXTS), lists.items()):
            total, found = _want(text, entries)
            assert (got[i][f"{name}_word_count"], dict(got[i][f"{name}_detected_words"])) == (total, found), (text, name)


def test_each_token_is_tested_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = analyze(rows, "text", vocabulary_from_entries(spark, LISTS["few"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(slice(" not in plan  # no shifted copies of all tokens
    assert analysis._shortest(["de", "d", "un", "da"]) == ["d", "un"]


def test_runs_of_sorted_values(spark):
    values = [[], None, ["a"], [None], ["b", "a", "b", None, None], ["a", "a", "a"]]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v array<string>")
    got = {r["id"]: r["p"] and [tuple(x) for x in r["p"]] for r in with_run_length(rows, rows.v, "p", ["id"]).collect()}
    for i, v in enumerate(values):
        assert got[i] == (None if v is None else sorted(collections.Counter(x for x in v if x is not None).items()))


def test_task_counts_are_summed_a_few_times(spark, monkeypatch):
    """Batch by batch the held terms were summed again: quadratic in the terms of a task."""
    calls = []
    monkeypatch.setattr(topk, "stage_table", lambda df, label: df)
    grab = {}

    class Long:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            grab["run"] = run
            return self

    topk.local_counts(Long(), "frequency")
    monkeypatch.setattr(topk, "WAITING", 100)
    real = pa.concat_tables
    monkeypatch.setattr(topk.pa, "concat_tables", lambda tables: calls.append(sum(t.num_rows for t in tables)) or real(tables))

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(topk, "TaskContext", Context)
    batches = [pa.record_batch({"category": ["c"] * 50, "term": [f"t{i * 50 + j}" for j in range(50)], "occ": pa.array([2] * 50, pa.int64())}) for i in range(200)]
    out = pa.Table.from_batches(list(grab["run"](iter(batches))))
    assert out.num_rows == 10_000 and set(out.column("frequency").to_pylist()) == {2}
    assert sum(calls) < 5 * 10_000  # a million when every batch was summed with all before


def test_long_form_keeps_maps_and_sums_strings(spark):
    rows = spark.sql("SELECT 1 AS id, map('a', 2L, 'b', 1L) AS m_detected_words, 'a: 1, a: 2' AS s_detected_words UNION ALL SELECT 2, NULL, NULL")
    got = {tuple(r) for r in detected_long(rows, ["id"]).collect()}
    assert got == {(1, "m", "a", 2), (1, "m", "b", 1), (1, "s", "a", 3)}
