"""Edges of reports, statistics and vocabularies: display strings, empty inputs, missing labels."""

from __future__ import annotations

import pytest

from termlens.functions.naming import allot, sanitize_columns
from termlens.operators import stats
from termlens.operators.detected import corpus_term_frequencies, top_terms_per_category
from termlens.operators.vocabulary import merge_wordlists


def test_doc_frequency_of_display_strings_without_a_key(spark):
    rows = [("happy: 2, sad: 1",), ("happy: 1",), ("happy: 1, able: 1",), (None,)]
    df = spark.createDataFrame(rows, "mood_detected_words string")
    got = {r["term"]: (r["frequency"], r["doc_frequency"]) for r in corpus_term_frequencies(df).collect()}
    assert got == {"happy": (4, 3), "sad": (1, 1), "able": (1, 1)}
    first = top_terms_per_category(df, 1, by="doc_frequency").collect()
    assert [r["term"] for r in first] == ["happy"]


def test_anova_without_complete_rows_is_an_error(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0)], "g string, v double")
    with pytest.raises(Exception, match="nothing to compare"):
        stats.anova_table(df, "g", "v").collect()


def test_nan_label_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (float("nan"), 3.0)], "g double, v double")
    assert {r["category"] for r in stats.group_statistics(df, "g", "v").collect()} == {"1.0", "2.0"}


def test_merge_of_nothing_is_empty(spark):
    merged = merge_wordlists([])
    assert merged.categories == [] and merged.table.count() == 0


def test_names_are_allotted_around_taken_ones():
    assert allot(["a", "A", "a_2"], ["a"]) == ["a_2", "A_3", "a_2_2"]
    assert sanitize_columns(["a", "a", "a_2", "!!"]) == ["a", "a_2", "a_2_2", "wordlist"]
