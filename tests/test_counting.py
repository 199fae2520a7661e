"""Counting rules (AGG-1..5, JN-1/2, LEG-1) on inline fixtures, both physical plans."""

from __future__ import annotations

import pytest

from termlens.operators.analyze import analyze
from termlens.operators.vocabulary import vocabulary_from_entries, vocabulary_from_wordlist

PLANS = ["rowlocal", "join"]


def _one(spark, text, entries, max_n=3, plan="rowlocal", convention="tokens"):
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    v = vocabulary_from_entries(spark, entries)
    return analyze(df, "text", v, max_n=max_n, plan=plan, key_col="id", convention=convention).first().asDict()


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize(
    "text,entries,max_n,expected",
    [
        ("happy happy happy", {"c": ["happy"]}, 3, 3),
        ("happy happy happy", {"c": ["happ*"]}, 3, 3),
        ("new york new york baby", {"c": ["new york"]}, 3, 2),
        ("new york new york baby", {"c": ["new *"]}, 2, 2),
        ("new york new haven baby", {"c": ["new *"]}, 3, 4),
        ("new york new york baby", {"c": ["new y*"]}, 2, 2),
        ("a b c a b c", {"c": ["a b c"]}, 2, 0),
        ("a b c a b c", {"c": ["a b c"]}, 3, 2),
        ("newark airport", {"c": ["new *"]}, 3, 1),
        ("happy day", {"c": ["happ*"]}, 3, 1),
        ("new york new york", {"c": ["*"]}, 3, 0),
        ("de des del", {"c": ["de", "de*", "d*", "de*"]}, 3, 4 + 3 + 3),
    ],
)
def test_counts(spark, plan, text, entries, max_n, expected):
    assert _one(spark, text, entries, max_n, plan)["c_word_count"] == expected


@pytest.mark.parametrize("plan", PLANS)
def test_nested_prefixes(spark, plan):
    r = _one(spark, "happy", {"Affect": ["ha*", "hap*"], "Mood": ["hap*"]}, plan=plan)
    assert r["Affect_word_count"] == 2 and r["Mood_word_count"] == 1


@pytest.mark.parametrize("plan", PLANS)
def test_detected_is_not_doubled(spark, plan):
    r = _one(spark, "happy happy happening", {"c": ["happ*", "happy"]}, plan=plan)
    assert r["c_detected_words"] == {"happy": 2, "happening": 1}
    assert r["c_word_count"] == 2 * 2 + 1  # happy: exact 2 + prefix 2; happening: prefix 1


@pytest.mark.parametrize("plan", PLANS)
def test_empty_and_missing(spark, plan):
    df = spark.createDataFrame([(1, ""), (2, None)], "id bigint, text string")
    v = vocabulary_from_entries(spark, {"c": ["happy"]})
    for r in analyze(df, "text", v, plan=plan, key_col="id").collect():
        assert (r["n_tokens"], r["n_types"], r["c_word_count"], r["c_word_perc"], r["c_detected_words"]) == (0, 0, 0, 0.0, {})


@pytest.mark.parametrize("plan", PLANS)
def test_d1_w1(spark, d1, w1, plan):
    rows = {r["id"]: r for r in analyze(d1, "text", w1, plan=plan, key_col="id").collect()}
    expect = {1: (5, 5, 3, 0.6), 2: (5, 5, 2, 0.4), 3: (3, 2, 4, 4 / 3), 4: (3, 3, 1, 1 / 3), 5: (3, 2, 4, 4 / 3), 6: (3, 3, 1, 1 / 3)}
    for i, (nt, ny, c, p) in expect.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_types"], r["wl1_Affect_word_count"]) == (nt, ny, c)
        assert r["wl1_Affect_word_perc"] == pytest.approx(p)
    assert rows[5]["wl1_Affect_detected_words"] == {"glad": 2, "happy": 1}
    assert list(rows[1].asDict())[:4] == ["id", "text", "group", "score"]


def test_w2_overlap(spark, w2_wide):
    v = vocabulary_from_wordlist(w2_wide)
    df = spark.createDataFrame([(1, "happy happy new york")], "id bigint, text string")
    r = analyze(df, "text", v).first()
    assert (r["Affect_word_count"], r["Place_word_count"]) == (4, 2)


def test_legacy_types_convention(spark):
    r = _one(spark, "happy happy happy", {"e": ["happy"], "w": ["happ*"]}, max_n=5, convention="types")
    assert (r["e_word_count"], r["w_word_count"]) == (1, 3)


def _norm(row) -> str:
    return repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in row.asDict().items()))


def test_plans_agree_on_documents(spark):
    """Row-local plan == join plan on real documents (counts and detected maps)."""
    from termlens.plans.catalog import TEST_WORDLIST, table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    v = vocabulary_from_entries(spark, TEST_WORDLIST)
    for conv, n in (("tokens", 3), ("types", 5)):
        a = analyze(docs, "text", v, plan="rowlocal", key_col="doc_id", keep_columns=False, max_n=n, convention=conv)
        b = analyze(docs, "text", v, plan="join", key_col="doc_id", keep_columns=False, max_n=n, convention=conv)
        assert a.columns == b.columns
        assert sorted(map(_norm, a.collect())) == sorted(map(_norm, b.collect()))


def test_result_independent_of_partitioning(spark):
    from termlens.plans.catalog import TEST_WORDLIST, table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    v = vocabulary_from_entries(spark, TEST_WORDLIST)
    a = analyze(docs.coalesce(1), "text", v, key_col="doc_id", keep_columns=False).collect()
    b = analyze(docs.repartition(7), "text", v, key_col="doc_id", keep_columns=False).collect()
    assert sorted(map(_norm, a)) == sorted(map(_norm, b))


def test_shuffle_join_equals_broadcast(spark):
    """The over-size path (frequent terms broadcast, the rest shuffled) returns the same hits."""
    from termlens.operators.matches import term_matches
    from termlens.plans.catalog import TEST_WORDLIST, table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    v = vocabulary_from_entries(spark, TEST_WORDLIST)
    a = term_matches(docs, "doc_id", "text", v)
    b = term_matches(docs, "doc_id", "text", v, broadcast_limit_bytes=0)
    assert "LeftAnti" in b._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in a._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_plans_agree_on_null_and_repeated_keys(spark):
    rows = [(1, "happy"), (1, "sad sad"), (None, "happy happy new york"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "`doc id` int, `my.text` string")
    v = vocabulary_from_entries(spark, {"Affect": ["happy", "sad", "sa*", "happ*"], "Place": ["new york", "new *", "ne*"]})
    for keep in (True, False):
        got = [
            sorted(map(_norm, analyze(df, "my.text", v, plan=plan, key_col="doc id", keep_columns=keep).collect()))
            for plan in ("rowlocal", "join")
        ]
        assert got[0] == got[1]
        assert len(got[0]) == len(rows)
    assert analyze(df, "my.text", v, plan="join").columns == analyze(df, "my.text", v).columns


def test_prefixes_of_every_shape_agree(spark):
    df = spark.createDataFrame(
        [(1, "newer york state of mind"), (2, "New York. new yorkers, of the people"), (3, "o of off 'tis état états-unis")],
        "id int, text string",
    )
    v = vocabulary_from_entries(
        spark, {"a": ["n*", "new*", "newer*", "new *", "new york*", "of the *", "o *", "ét*"], "b": ["new *", "new *", "york s*", "of mind*"]}
    )
    for conv in ("tokens", "types"):
        a = analyze(df, "text", v, plan="rowlocal", convention=conv)
        b = analyze(df, "text", v, plan="join", convention=conv)
        assert sorted(map(_norm, a.collect())) == sorted(map(_norm, b.collect()))


def test_auto_plan_switches_above_literal_threshold(spark):
    from termlens.plans.catalog import TEST_WORDLIST, table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    v = vocabulary_from_entries(spark, TEST_WORDLIST)
    small = analyze(docs, "text", v, key_col="doc_id", keep_columns=False)
    big = analyze(docs, "text", v, key_col="doc_id", keep_columns=False, literal_threshold=5)
    assert "pythonUDF" in big._jdf.queryExecution().optimizedPlan().toString()
    assert "pythonUDF" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(_norm, small.collect())) == sorted(map(_norm, big.collect()))


def test_matches_in_the_row_equal_the_shuffled_ones(spark):
    from termlens.operators.matches import analyze_by_join
    from termlens.plans.catalog import TEST_WORDLIST, table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame([(None, None), (1, ""), (1, "de la de la")], "doc_id long, text string"))
    v = vocabulary_from_entries(spark, {**TEST_WORDLIST, "none": ["zzzzqq"]})
    for convention in ("tokens", "types"):
        here = analyze_by_join(docs, "text", v, convention=convention)
        plan = here._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan  # the text stays where it is
        moved = analyze_by_join(docs, "text", v, convention=convention, broadcast_limit_bytes=0)
        assert "Join" in moved._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(_norm, here.collect())) == sorted(map(_norm, moved.collect()))
    nothing = analyze_by_join(docs, "text", vocabulary_from_entries(spark, {"c": ["zzzzqq"]}), with_detected=False)
    assert {r["c_word_count"] for r in nothing.collect()} == {0}
