"""Statistics (AGG-7..13), distributions, detected reports (AGG-6, TOP-*), enhance/paging (PRJ-*, LIM-*)."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql.utils import AnalysisException

from termlens.functions.distributions import f_sf, pearson_p, qtukey, t_ppf
from termlens.operators import stats
from termlens.operators.analyze import analyze
from termlens.operators.detected import corpus_term_frequencies, top_terms, top_terms_per_category
from termlens.operators.enhance import drop_text, enhance, page, profile, to_json_records


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- distributions
def test_distribution_tables():
    assert t_ppf(0.975, 2) == pytest.approx(4.302653, abs=1e-6)
    assert t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert t_ppf(0.975, 1) == pytest.approx(12.706205, abs=1e-5)
    assert f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert pearson_p(0.5, 10) == pytest.approx(0.141113, abs=1e-6)
    assert qtukey(0.95, 3, 5) == pytest.approx(4.602, abs=2e-3)
    assert qtukey(0.95, 5, 20) == pytest.approx(4.232, abs=2e-3)
    assert qtukey(0.95, 3, float("inf")) == pytest.approx(3.314, abs=2e-3)


# --------------------------------------------------------------------------- pearson
def test_pearson_by_hand(spark):
    primes = [2.0, 3.0, 5.0, 7.0, 11.0, 13.0]
    for slope in (7.0, -3.0):
        r = stats.pearson(_df(spark, [(x, slope * x + 0.5) for x in primes], "x double, y double"), "x", "y").first()
        assert (r["coefficient"], r["p_value"], r["n"]) == (pytest.approx(slope / abs(slope)), pytest.approx(0.0, abs=1e-12), 6)
    # centred products 3, squares 5 and 5, so r = 3 / 5; with two degrees of freedom p is 1 - r
    r = stats.pearson(_df(spark, [(0.0, 1.0), (1.0, 0.0), (2.0, 3.0), (3.0, 2.0)], "x double, y double"), "x", "y").first()
    assert (r["coefficient"], r["p_value"]) == (pytest.approx(0.6), pytest.approx(0.4))


def test_pearson_leaves_incomplete_rows_out(spark):
    df = _df(spark, [(4.0, 9.0), (6.0, 13.0), (None, 2.0), (10.0, 21.0), (5.0, float("nan"))], "x double, y double")
    r = stats.pearson(df, "x", "y").first()
    assert r["n"] == 3 and r["coefficient"] == pytest.approx(1.0)


def test_pearson_errors(spark):
    df = _df(spark, [(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    with pytest.raises(ValueError):
        stats.pearson(df, "x", "x")
    with pytest.raises(Exception, match="no variance"):
        stats.pearson(df, "x", "y").collect()
    with pytest.raises(Exception, match="at least 2"):
        stats.pearson(_df(spark, [(1.0, 2.0), (None, 3.0)], "x double, y double"), "x", "y").collect()


def test_d1_pearson_and_anova(spark, d1, w1):
    a = analyze(d1, "text", w1)
    r = stats.pearson(a, "score", "n_tokens").first()
    assert r["n"] == 6 and r["coefficient"] == pytest.approx(0.204124, abs=1e-6)
    t = {x["source"]: x for x in stats.anova_table(d1, "group", "score").collect()}
    assert t["C(group)"]["sum_sq"] == pytest.approx(16.6667, abs=1e-4)
    assert t["Residual"]["sum_sq"] == pytest.approx(1.3333, abs=1e-4)
    assert (t["C(group)"]["df"], t["Residual"]["df"]) == (1.0, 4.0)
    assert t["C(group)"]["F"] == pytest.approx(50.0)
    assert t["C(group)"]["PR(>F)"] < 0.05
    s = stats.anova_summary(d1, "group", "score").first()
    assert s["significant"] is True


# --------------------------------------------------------------------------- groups
def test_group_statistics_by_hand(spark):
    rows = [("north", 2.5), ("south", 20.0), ("north", 7.5), ("south", 24.0), ("west", -4.0), ("south", 31.0), ("east", None), ("east", float("nan")), (None, 8.0)]
    df = _df(spark, rows, "cat string, val double")
    g = {r["category"]: r for r in stats.group_statistics(df, "cat", "val").collect()}
    assert {k: (r["mean"], r["n"]) for k, r in g.items()} == {"north": (5.0, 2), "south": (25.0, 3), "west": (-4.0, 1)}
    assert g["west"]["sem"] == 0.0 and g["west"]["ci_lower"] == g["west"]["ci_upper"] == -4.0
    # north: deviations of 2.5 give a standard error of 2.5; t(0.975, 1) is the tangent of 0.475 pi
    assert g["north"]["sem"] == pytest.approx(2.5)
    assert g["north"]["ci_upper"] - 5.0 == pytest.approx(2.5 * math.tan(0.475 * math.pi), rel=1e-9)
    z = {r["category"]: r for r in stats.group_statistics(df, "cat", "val", interval="z").collect()}
    assert (z["north"]["ci_lower"], z["north"]["ci_upper"]) == (pytest.approx(0.1), pytest.approx(9.9))
    bars = {r["category"]: r for r in stats.mean_bars(df, "cat", "val").collect()}
    assert bars["south"]["err_plus"] == pytest.approx(bars["south"]["err_minus"]) == pytest.approx(g["south"]["ci_upper"] - 25.0)


def test_anova_and_tukey_by_hand(spark):
    df = _df(spark, [("p", 10.0), ("p", 12.0), ("q", 11.0), ("q", 13.0), ("r", 30.0), ("r", 34.0)], "cat string, val double")
    table = {r["source"]: r for r in stats.anova_table(df, "cat", "val").collect()}
    # means 11, 12 and 32 around 55 / 3; squares within 2 + 2 + 8
    between = 2 * sum((m - 55 / 3) ** 2 for m in (11, 12, 32))
    assert table["C(cat)"]["sum_sq"] == pytest.approx(between) and table["Residual"]["sum_sq"] == pytest.approx(12.0)
    assert table["C(cat)"]["F"] == pytest.approx((between / 2) / (12 / 3))
    assert stats.anova_summary(df, "cat", "val").first()["significant"] is True
    rows = {(r["group1"], r["group2"]): r for r in stats.tukey_hsd(df, "cat", "val").collect()}
    assert {k: (r["meandiff"], r["reject"]) for k, r in rows.items()} == {("p", "q"): (1.0, False), ("p", "r"): (21.0, True), ("q", "r"): (20.0, True)}
    assert all(r["lower"] < r["meandiff"] < r["upper"] for r in rows.values())
    with pytest.raises(Exception, match="at least 2 groups"):
        stats.anova_table(df.where("cat = 'p'"), "cat", "val").collect()


def test_anova_of_shifted_and_equal_groups(spark):
    values = [(i * 37 % 101) / 101 for i in range(101)]
    for shift, differs in ((0.4, True), (0.0, False)):
        rows = [(g, v + shift * k) for k, g in enumerate("uvw") for v in values[k::3]]
        assert stats.anova_summary(_df(spark, rows, "cat string, val double"), "cat", "val").first()["significant"] is differs


def test_ols_and_correlation_pairs(spark):
    df = _df(spark, [(float(x), 3.0 * x + 1.0, float(x % 3)) for x in range(10)], "x double, y double, z double")
    t = stats.ols_trend(df, "x", "y").first()
    assert (t["slope"], t["intercept"], t["r2"], t["n"]) == (pytest.approx(3.0), pytest.approx(1.0), pytest.approx(1.0), 10)
    pairs = {(r["col1"], r["col2"]): r for r in stats.correlation_pairs(df, ["x", "y", "z"]).collect()}
    assert pairs[("x", "y")]["coefficient"] == pytest.approx(1.0)
    single = stats.pearson(df, "x", "z").first()
    assert pairs[("x", "z")]["coefficient"] == pytest.approx(single["coefficient"])
    assert pairs[("x", "z")]["p_value"] == pytest.approx(single["p_value"])


# --------------------------------------------------------------------------- detected reports
def test_corpus_terms(spark):
    df = _df(spark, [(1, {"happy": 2, "sad": 1}), (2, {"happy": 1, "angry": 3}), (3, {}), (4, None)], "id int, c_detected_words map<string,bigint>")
    got = {r["term"]: (r["frequency"], r["doc_frequency"]) for r in corpus_term_frequencies(df, row_key="id").collect()}
    assert got == {"happy": (3, 2), "angry": (3, 1), "sad": (1, 1)}
    ties = _df(spark, [(1, {"zebra": 2, "apple": 2, "mango": 2})], "id int, c_detected_words map<string,bigint>")
    assert [r["term"] for r in top_terms(ties, "c", 3).orderBy("rank").collect()] == ["apple", "mango", "zebra"]
    four = _df(spark, [(1, {"a": 1, "b": 2, "c": 3, "d": 4})], "id int, c_detected_words map<string,bigint>")
    assert [r["term"] for r in top_terms(four, "c", 2).orderBy("rank").collect()] == ["d", "c"]


def test_corpus_terms_from_strings(spark):
    df = _df(spark, [(1, "happy: 2, sad: 1"), (2, "happy: 1"), (3, ""), (4, "happy, sad, happy"), (5, "happy: 2, sad: notanum")], "id int, c_detected_words string")
    got = {r["term"]: (r["frequency"], r["doc_frequency"]) for r in corpus_term_frequencies(df, row_key="id").collect()}
    assert got == {"happy": (7, 4), "sad": (2, 2)}


def test_d1_terms_and_top_per_category(spark, d1, w1):
    a = analyze(d1, "text", w1)
    got = {r["term"]: (r["frequency"], r["doc_frequency"]) for r in corpus_term_frequencies(a, row_key="id").collect()}
    assert got == {"happy": (4, 3), "glad": (3, 2), "angry": (2, 2), "sad": (2, 2)}
    top = top_terms_per_category(a, 2).orderBy("rank").collect()
    assert [(r["term"], r["rank"]) for r in top] == [("happy", 1), ("glad", 2)]
    with pytest.raises(Exception):
        top_terms(a, "nope", 3)


# --------------------------------------------------------------------------- enhance, paging, profile
def test_enhance_layout(spark):
    df = _df(spark, [(1, "happy day", 0.1, None), (2, "sad sad night", 0.2, "x"), (3, "new york baby", 0.3, None)], "id bigint, text string, score double, maybe_missing string")
    from termlens.operators.vocabulary import vocabulary_from_entries

    v = vocabulary_from_entries(spark, {"Affect": ["happy", "sad"]})
    e = enhance(df, "text", v)
    assert e.columns == ["id", "text", "score", "maybe_missing", "n_tokens", "n_types", "Affect_word_count", "Affect_word_perc", "Affect_detected_words"]
    rows = {r["id"]: r for r in e.collect()}
    assert rows[1]["maybe_missing"] is None and rows[2]["maybe_missing"] == "x"
    assert rows[2]["Affect_detected_words"] == "sad: 2" and rows[3]["Affect_detected_words"] == ""
    assert dict(e.dtypes)["id"] == "bigint"
    clash = df.withColumnRenamed("maybe_missing", "n_tokens")
    assert "n_tokens_2" in enhance(clash, "text", v).columns
    assert drop_text(e, "text", df.columns).columns[:2] == ["id", "score"]


def test_paging(spark, d1, w1):
    e = enhance(d1, "text", w1)
    assert [r["id"] for r in page(e, ["id"], 1, 1).collect()] == [2]
    assert page(e, ["id"], 100, 5).count() == 0
    assert page(e, ["id"], 4, 10).count() == 2
    recs = to_json_records(e, ["id"], 0, 2, ["id", "text"]).collect()
    assert recs[0]["value"] == '{"id":1,"text":"I am happy and glad"}'


def test_profile(spark, d1):
    p = {r["column_name"]: r for r in profile(d1).collect()}
    assert p["id"]["data_type"] == "bigint" and p["text"]["n_rows"] == 6 and p["score"]["n_null"] == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 1
    assert set(E.oracle_sql()) <= set(E.queries())
