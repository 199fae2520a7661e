"""Registered queries over the test tables (``documents``, ``conversations``, ``benchmark``,
``labels``, ``lineitem``): one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads whole tables; the only fixed input is the dictionary used
to analyse the texts, exactly as a user's dictionary would be.  Doubles are
rounded to 6 decimals so the DuckDB oracle can compare values exactly.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.functions.text import LEGACY_MAX_N, explode_rows, all_ngrams, format_detected, ngram_orders, ngrams, parse_detected, text_column_of, tokenize, with_run_length
from termlens.operators import stats
from termlens.operators.analyze import analyze, analysis_frame
from termlens.operators.detected import corpus_term_frequencies, detected_long, top_terms, top_terms_per_category
from termlens.operators.enhance import (
    categorical_columns,
    drop_text,
    enhance,
    enhanced_page,
    numeric_columns,
    page,
    page_after,
    profile,
    select_columns,
    text_columns,
    to_json_records,
)
from termlens.operators.matches import term_matches
from termlens.operators.vocabulary import (
    Vocabulary,
    merge_wordlists,
    vocabulary_from_entries,
    vocabulary_from_wordlist,
    vocabulary_head_tail,
    vocabulary_summary,
)
from termlens.plans.strategy import balance
from termlens.session import ensure_checkpoint_dir

# The test dictionary (function words of the four languages in
# the test corpus; wildcard entries end in "*").
TEST_WORDLIST: dict[str, list[str]] = {
    "art": ["the", "a", "der", "die", "das", "la", "le", "el", "les", "los", "un", "une"],
    "prep": ["of", "to", "in", "for", "on", "de", "des", "von", "zu", "en", "de*", "d*"],
    "conj": ["and", "und", "et", "un*"],
    "phr": ["of the", "de la", "the the", "of the the", "the *", "de l*"],
}
PREFIX_SINGLE_WORDLIST = {"pfx": ["de*", "d*", "un*", "th*", "wh*"]}
EXACT_MULTI_WORDLIST = {"phx": ["of the", "de la", "the the", "of the the", "der der"]}
PREFIX_MULTI_WORDLIST = {"php": ["the *", "de l*", "of the *", "und d*"]}
OVERLAP_WORDLIST = {"ov": ["de", "de*", "d*", "de*"]}
CATEGORIES = ["art", "conj", "phr", "prep"]
TOP_N = 10
ROUND = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _r(c):
    return F.round(c, ROUND)


_VOCABS: dict = {}


def _vocab(spark: SparkSession, entries=None) -> Vocabulary:
    """The fixed test dictionary as a Vocabulary, built once per session and dictionary."""
    entries = entries or TEST_WORDLIST
    key = repr(sorted(entries.items()))
    known = _VOCABS.get(key)
    if known is None or known.table.sparkSession.sparkContext is not spark.sparkContext:
        _VOCABS[key] = vocabulary_from_entries(spark, entries)
    return _VOCABS[key]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _spread_docs(spark, sf_dir):
    """For queries that use the text functions directly (the operators spread small inputs themselves)."""
    return balance(_docs(spark, sf_dir))


def _analysis(spark, sf_dir, entries=None, **kw) -> DataFrame:
    return analysis_frame(_docs(spark, sf_dir), "text", _vocab(spark, entries), key_col="doc_id", **kw)


def _counts_only(df: DataFrame, cats, perc: bool = False) -> DataFrame:
    cols = ["doc_id"] + [f"{c}_word_count" for c in cats]
    if perc:
        cols += [f"{c}_word_perc" for c in cats]
    return df.select(*[F.col(c) if not c.endswith("_perc") else _r(F.col(c)).alias(c) for c in cols])


# --------------------------------------------------------------------------- #
# tokens and n-grams
# --------------------------------------------------------------------------- #
def q_tokenize_stats(spark, sf_dir):
    d = _spread_docs(spark, sf_dir)
    t = d.select("doc_id", tokenize(text_column_of(d, "text")).alias("tk"))
    return t.select("doc_id", F.size("tk").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("tk")).cast("bigint").alias("n_types"))


def q_token_freq_by_lang(spark, sf_dir):
    d = _spread_docs(spark, sf_dir)
    t = with_run_length(d, tokenize(text_column_of(d, "text")), "pairs", ["lang"])
    return (
        explode_rows(t, ["lang"], F.col("pairs"), "p")
        .groupBy("lang", F.col("p.term").alias("term"))
        .agg(F.sum("p.occ").cast("bigint").alias("frequency"), F.count(F.lit(1)).cast("bigint").alias("doc_frequency"))
    )


def _ngram_top(spark, sf_dir, n, k=25):
    from termlens.operators.grams import top_ngrams

    d = _spread_docs(spark, sf_dir)
    rows = d.select(F.col("lang").alias("category"), tokenize(text_column_of(d, "text")).alias("tk"))
    return top_ngrams(rows, n, k).withColumnRenamed("category", "lang")


def q_ngram_bigrams_top(spark, sf_dir):
    return _ngram_top(spark, sf_dir, 2)


def q_ngram_trigrams_top(spark, sf_dir):
    return _ngram_top(spark, sf_dir, 3)


def q_clean_and_tokenize(spark, sf_dir):
    d = _spread_docs(spark, sf_dir)
    tk = tokenize(text_column_of(d, "text"))
    base = d.select("doc_id", tk.alias("tk"))
    grams = all_ngrams(F.col("tk"), ngram_orders(3))
    return base.select(
        "doc_id",
        F.size("tk").cast("bigint").alias("n_tokens"),
        F.size(grams).cast("bigint").alias("n_ngrams"),
        F.size(F.array_distinct(grams)).cast("bigint").alias("n_distinct_ngrams"),
    )


# --------------------------------------------------------------------------- #
# matching
# --------------------------------------------------------------------------- #
def q_exact_single_counts(spark, sf_dir):
    return _counts_only(_analysis(spark, sf_dir, {"art": TEST_WORDLIST["art"]}, with_detected=False), ["art"])


def q_prefix_single_counts(spark, sf_dir):
    return _counts_only(_analysis(spark, sf_dir, PREFIX_SINGLE_WORDLIST, with_detected=False), ["pfx"])


def q_exact_multi_counts(spark, sf_dir):
    return _counts_only(_analysis(spark, sf_dir, EXACT_MULTI_WORDLIST, with_detected=False), ["phx"])


def q_prefix_multi_counts(spark, sf_dir):
    return _counts_only(_analysis(spark, sf_dir, PREFIX_MULTI_WORDLIST, with_detected=False), ["php"])


def q_overlap_double_count(spark, sf_dir):
    return _counts_only(_analysis(spark, sf_dir, OVERLAP_WORDLIST, with_detected=False), ["ov"])


def q_analyze_wide(spark, sf_dir):
    a = _analysis(spark, sf_dir, with_detected=False)
    cols = [F.col("doc_id"), F.col("n_tokens"), F.col("n_types")]
    for c in CATEGORIES:
        cols += [F.col(f"{c}_word_count"), _r(F.col(f"{c}_word_perc")).alias(f"{c}_word_perc")]
    return a.select(*cols)


def q_analyze_join_plan(spark, sf_dir):
    """Same as analyze_wide, forced through the join plan (shape B)."""
    a = _analysis(spark, sf_dir, with_detected=False, plan="join")
    cols = [F.col("doc_id"), F.col("n_tokens"), F.col("n_types")]
    for c in CATEGORIES:
        cols += [F.col(f"{c}_word_count"), _r(F.col(f"{c}_word_perc")).alias(f"{c}_word_perc")]
    return a.select(*cols)


def q_word_perc(spark, sf_dir):
    a = _analysis(spark, sf_dir, with_detected=False)
    return a.select("doc_id", *[_r(F.col(f"{c}_word_perc")).alias(f"{c}_word_perc") for c in CATEGORIES])


def q_detected_long(spark, sf_dir):
    return detected_long(_analysis(spark, sf_dir), ["doc_id"], CATEGORIES)


def q_detected_display(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return a.select("doc_id", *[format_detected(f"{c}_detected_words").alias(f"{c}_detected_words") for c in CATEGORIES])


def q_detected_parse(spark, sf_dir):
    return detected_long(q_detected_display(spark, sf_dir), ["doc_id"], CATEGORIES)


def q_term_matches(spark, sf_dir):
    return term_matches(_docs(spark, sf_dir), "doc_id", "text", _vocab(spark))


def q_legacy_type_counts(spark, sf_dir):
    a = _analysis(spark, sf_dir, with_detected=False, convention="types", max_n=LEGACY_MAX_N)
    return _counts_only(a, CATEGORIES)


def q_category_select(spark, sf_dir):
    v = _vocab(spark).select(["art", "phr", "no_such_category"])
    a = analysis_frame(_docs(spark, sf_dir), "text", v, key_col="doc_id", with_detected=False)
    return a.select("doc_id", "art_word_count", "phr_word_count")


def q_conversation_roles_analyze(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    a = analyze(conv, "text", _vocab(spark), with_detected=False)
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_turns"), F.sum("n_tokens").cast("bigint").alias("n_tokens")]
    for c in CATEGORIES:
        aggs += [F.sum(f"{c}_word_count").cast("bigint").alias(f"{c}_word_count"), _r(F.avg(f"{c}_word_perc")).alias(f"{c}_mean_perc")]
    return a.groupBy("role").agg(*aggs)


# --------------------------------------------------------------------------- #
# corpus reports
# --------------------------------------------------------------------------- #
def q_corpus_term_freq(spark, sf_dir):
    return corpus_term_frequencies(_analysis(spark, sf_dir), CATEGORIES, row_key="doc_id")


def q_top_terms_one_category(spark, sf_dir):
    return top_terms(_analysis(spark, sf_dir), "prep", TOP_N)


def q_top_terms_all_categories(spark, sf_dir):
    return top_terms_per_category(_analysis(spark, sf_dir), 5)


def q_top_terms_by_docs(spark, sf_dir):
    return top_terms_per_category(_analysis(spark, sf_dir), 3, by="doc_frequency")


# --------------------------------------------------------------------------- #
# enhanced dataset, paging, sinks
# --------------------------------------------------------------------------- #
def _enhanced(spark, sf_dir, entries=None) -> DataFrame:
    e = enhance(_docs(spark, sf_dir), "text", _vocab(spark, entries))
    return e.select(*[_r(F.col(c)).alias(c) if c.endswith("_word_perc") else F.col(c) for c in e.columns])


def q_enhance(spark, sf_dir):
    return _enhanced(spark, sf_dir)


def q_sanitized_columns(spark, sf_dir):
    d = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("doc id"),
        F.col("lang").alias("Lang!"),
        F.col("source").alias("n_tokens"),
        F.col("text").alias("Text"),
    )
    e = enhance(d, "Text", _vocab(spark, {"art": TEST_WORDLIST["art"]}))
    return e.select(*[_r(F.col(c)).alias(c) if c.endswith("_word_perc") else F.col(c) for c in e.columns])


def _rounded_shares(e: DataFrame) -> DataFrame:
    return e.select(*[_r(F.col(c)).alias(c) if c.endswith("_word_perc") else F.col(c) for c in e.columns])


def q_enhanced_page(spark, sf_dir):
    return _rounded_shares(enhanced_page(table(spark, sf_dir, "documents"), "text", _vocab(spark), ["doc_id"], offset=100, limit=50))


def q_page_after_key(spark, sf_dir):
    """Keyset paging over (source, doc_id): the page after a given row."""
    d = table(spark, sf_dir, "documents")
    return page_after(d, ["source", "doc_id"], ["src1", 41], 40, ["doc_id", "lang", "source", "n_chars"])


def q_json_records_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return to_json_records(d, ["doc_id"], 100, 50, ["doc_id", "lang", "source", "n_chars"])


def q_select_columns(spark, sf_dir):
    return select_columns(_enhanced(spark, sf_dir), ["prep_word_count", "doc_id", "n_tokens"])


def q_legacy_detected(spark, sf_dir):
    """The older list form of the detected columns (terms only)."""
    e = enhance(_docs(spark, sf_dir), "text", _vocab(spark), max_n=LEGACY_MAX_N, convention="types")
    return e.select("doc_id", *[f"{c}_detected_words" for c in CATEGORIES])


def q_top_terms_enhanced(spark, sf_dir):
    return top_terms(_enhanced(spark, sf_dir), "prep", TOP_N)


def q_top_terms_by_docs_enhanced(spark, sf_dir):
    return top_terms_per_category(_enhanced(spark, sf_dir), 3, by="doc_frequency")


def q_corpus_terms_from_display(spark, sf_dir):
    return corpus_term_frequencies(_enhanced(spark, sf_dir), CATEGORIES)


def _scratch(spark) -> str:
    """A fresh folder under the shared checkpoint root (never a machine-local temp dir)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/exports/{uuid.uuid4().hex}"


def q_export_without_text(spark, sf_dir):
    from termlens.sources.sinks import export

    e = _enhanced(spark, sf_dir)
    d = _docs(spark, sf_dir)
    out = drop_text(e, "text", d.columns + [c for c in e.columns[len(d.columns):]])
    path = _scratch(spark)
    export(out, path, "parquet")
    return spark.read.parquet(path)


def q_csv_roundtrip(spark, sf_dir):
    from termlens.sources.datasets import read_dataset
    from termlens.sources.sinks import export

    e = _enhanced(spark, sf_dir)
    path = _scratch(spark)
    export(e, path, "csv")
    back = read_dataset(spark, path, fmt="csv", schema=e.schema)
    return back


def q_tsv_roundtrip(spark, sf_dir):
    from termlens.sources.datasets import read_dataset
    from termlens.sources.sinks import export

    e = _enhanced(spark, sf_dir)
    path = _scratch(spark)
    export(e, path, "tsv")
    return read_dataset(spark, path, fmt="tsv", schema=e.schema)


def q_parquet_roundtrip(spark, sf_dir):
    from termlens.sources.sinks import export

    e = _enhanced(spark, sf_dir)
    path = _scratch(spark)
    export(e, path, "parquet")
    return spark.read.parquet(path)


def q_dataset_profile(spark, sf_dir):
    return profile(_docs(spark, sf_dir))


def q_dataset_preview(spark, sf_dir):
    return page(_docs(spark, sf_dir), ["doc_id"], 0, 5)


# --------------------------------------------------------------------------- #
# table-derived wordlists (vocabulary operators on data that grows with the tables)
# --------------------------------------------------------------------------- #
def benchmark_wordlist(spark, sf_dir, variant: int = 1) -> DataFrame:
    """A wide wordlist built from ``benchmark`` texts, in one scan.

    Rows: every distinct raw word (categories by length: short <= 3, medium
    4..6, long >= 7); a 4-letter prefix entry ``abcd*`` per long word (a bag:
    words sharing a prefix repeat it); every adjacent word pair (category
    ``phrase``, cell written `` x ``) and each pair's first word as ``w *``.
    ``variant=2`` keeps only the short/phrase columns (for merge tests).
    """
    ws = F.col("ws")
    shifted = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(ws, shifted, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())

    def item(kind: str, term):
        return F.struct(F.lit(kind).alias("kind"), term.alias("w"))

    texts = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0).alias("ws"))
    split = texts.select("ws", pairs.alias("ps"))
    items = F.concat(
        F.transform(ws, lambda w: item("word", w)),
        F.transform(F.filter(ws, lambda w: F.length(w) >= 7), lambda w: item("prefix", w)),
        F.transform("ps", lambda p: item("phrase", F.concat_ws(" ", p["x"], p["y"]))),
        F.transform("ps", lambda p: item("opener", p["x"])),
    )
    entries = explode_rows(split, [], items, "i").select("i.kind", "i.w").distinct()
    kind, n = F.col("kind"), F.length("w")
    word = kind == "word"
    wide = entries.select(
        F.when(kind == "prefix", F.concat(F.substring("w", 1, 4), F.lit("*")))
        .when(kind == "opener", F.concat(F.col("w"), F.lit(" *")))
        .otherwise(F.col("w")).alias("DicTerm"),
        F.when(word & (n <= 3), "X").alias("short"),
        F.when(word & n.between(4, 6), " x ").alias("medium"),
        F.when((word & (n >= 7)) | (kind == "prefix"), "X").alias("long"),
        F.when(kind == "phrase", " x ").when(kind == "opener", "X").alias("phrase"),
    )
    if variant == 2:
        return wide.select("DicTerm", "short", "phrase")
    return wide


def q_vocab_unpivot(spark, sf_dir):
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    return v.table.select("category", "match_kind", "is_multi", "key", "key_len", "n_words", "weight")


def q_vocab_merge(spark, sf_dir):
    v = merge_wordlists([(benchmark_wordlist(spark, sf_dir), "bench.csv"), (benchmark_wordlist(spark, sf_dir, 2), "bench.tsv")])
    return v.table.select("namespace", "category", "category_pos", "match_kind", "is_multi", "key", "weight")


def q_vocab_summary(spark, sf_dir):
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    return vocabulary_summary(v).select("category", "n_terms", "sample_terms")


def q_vocab_head_tail(spark, sf_dir):
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    return vocabulary_head_tail(v).select("category", "n_terms", "summary")


def _vocab_with_unused(spark, sf_dir) -> Vocabulary:
    return vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir).withColumn("unused", F.lit(None).cast("string")))


def q_vocab_summary_empty_category(spark, sf_dir):
    return vocabulary_summary(_vocab_with_unused(spark, sf_dir)).select("category", "category_pos", "n_terms", "sample_terms")


def q_vocab_head_tail_empty_category(spark, sf_dir):
    return vocabulary_head_tail(_vocab_with_unused(spark, sf_dir)).select("category", "category_pos", "n_terms", "summary")


def q_vocab_terms_for(spark, sf_dir):
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    return v.terms_for("long").select("match_kind", "is_multi", "key", "weight")


def q_vocab_union(spark, sf_dir):
    """Bag union of two vocabularies that share categories."""
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir)).union(vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir, 2)))
    return v.table.select("category", "category_pos", "match_kind", "is_multi", "key", "weight")


def q_wordlist_formats(spark, sf_dir):
    """The wordlist written and read again in both delimited formats."""
    from termlens.sources.datasets import read_wordlist
    from termlens.sources.sinks import export

    wide, out = benchmark_wordlist(spark, sf_dir), []
    for fmt in ("csv", "tsv"):
        path = _scratch(spark)
        export(wide, path, fmt)
        v = vocabulary_from_wordlist(read_wordlist(spark, path, fmt=fmt))
        out.append(v.table.select(F.lit(fmt).alias("fmt"), "category", "match_kind", "is_multi", "key", "weight"))
    return out[0].unionByName(out[1])


def q_csv_infer_na(spark, sf_dir):
    """``labels`` as csv with ``NA`` cells, read with inferred types: a statistic works on the column."""
    from termlens.sources.datasets import read_dataset
    from termlens.sources.sinks import export

    path = _scratch(spark)
    cells = F.when(F.col("quality") == 1, F.col("toxic").cast("string")).otherwise("NA")
    export(table(spark, sf_dir, "labels").select("doc_id", cells.alias("score")), path, "csv")
    back = read_dataset(spark, path, fmt="csv")
    return back.select("doc_id", (F.col("score") / 2).alias("half_score"))


def q_read_usecols_dtype(spark, sf_dir):
    from termlens.sources.datasets import read_dataset
    from termlens.sources.sinks import export

    path = _scratch(spark)
    export(table(spark, sf_dir, "documents"), path, "tsv")
    return read_dataset(spark, path, fmt="tsv", usecols=["n_chars", "doc_id", "lang"], dtype={"n_chars": "string"})


def q_analyze_large_vocab_nokey(spark, sf_dir):
    """The benchmark-derived dictionary, join plan, no key column."""
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    a = analyze(_docs(spark, sf_dir), "text", v, plan="join", with_detected=False)
    return a.select("doc_id", "n_tokens", *[f"{c}_word_count" for c in v.categories])


def q_analyze_duplicate_and_null_keys(spark, sf_dir):
    """Keys made null or repeated: every row keeps its own counts."""
    d = _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 100).cast("string")).alias("k"), "text")
    a = analysis_frame(d, "text", _vocab(spark), key_col="k", plan="join", with_detected=False)
    return a.select("k", "n_tokens", "n_types", *[f"{c}_word_count" for c in CATEGORIES])


def q_analyze_table_vocab(spark, sf_dir):
    """Documents against the benchmark-derived dictionary, long form, join plan."""
    v = vocabulary_from_wordlist(benchmark_wordlist(spark, sf_dir))
    a = analysis_frame(_docs(spark, sf_dir), "text", v, key_col="doc_id", plan="join", with_detected=False)
    cats = v.categories
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_word_count").alias("word_count")) for c in cats])
    return explode_rows(a, ["doc_id"], rows, "r").select("doc_id", "r.category", "r.word_count").filter(F.col("word_count") > 0)


# --------------------------------------------------------------------------- #
# statistics
# --------------------------------------------------------------------------- #
def _round_cols(df: DataFrame, cols) -> DataFrame:
    return df.select(*[_r(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def q_pearson(spark, sf_dir):
    p = stats.pearson(_analysis(spark, sf_dir, with_detected=False), "n_tokens", "art_word_perc")
    return _round_cols(p, ["coefficient", "p_value"])


def q_correlation_pairs(spark, sf_dir):
    a = _analysis(spark, sf_dir, with_detected=False)
    p = stats.correlation_pairs(a, ["n_tokens", "n_types"] + [f"{c}_word_perc" for c in CATEGORIES])
    return _round_cols(p, ["coefficient", "p_value"])


def q_ols_trend(spark, sf_dir):
    t = stats.ols_trend(_analysis(spark, sf_dir, with_detected=False), "n_tokens", "art_word_count")
    return _round_cols(t, ["slope", "intercept", "r2", "x_min", "x_max", "y_at_min", "y_at_max"])


def _enh_stats(spark, sf_dir):
    return analyze(_docs(spark, sf_dir), "text", _vocab(spark), with_detected=False)


def q_group_ci_t(spark, sf_dir):
    g = stats.group_statistics(_enh_stats(spark, sf_dir), "lang", "art_word_perc")
    return _round_cols(g, ["mean", "sem", "ci_lower", "ci_upper"])


def q_group_ci_z(spark, sf_dir):
    g = stats.group_statistics(_enh_stats(spark, sf_dir), "source", "prep_word_perc", interval="z")
    return _round_cols(g, ["mean", "sem", "ci_lower", "ci_upper"])


def q_mean_bars(spark, sf_dir):
    g = stats.mean_bars(_enh_stats(spark, sf_dir), "source", "art_word_perc")
    return _round_cols(g, ["mean", "err_plus", "err_minus"])


def q_anova_table(spark, sf_dir):
    t = stats.anova_table(_enh_stats(spark, sf_dir), "lang", "art_word_perc")
    return _round_cols(t, ["sum_sq", "df", "F", "PR(>F)"])


def q_anova_summary(spark, sf_dir):
    return _round_cols(stats.anova_summary(_enh_stats(spark, sf_dir), "lang", "art_word_perc"), ["p_value"])


def q_scatter_points(spark, sf_dir):
    return stats.scatter_points(_analysis(spark, sf_dir, with_detected=False), "n_tokens", "art_word_count")


def q_anova_labels(spark, sf_dir):
    joined = _enh_stats(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    t = stats.anova_table(joined, "quality", "conj_word_perc")
    return _round_cols(t, ["sum_sq", "df", "F", "PR(>F)"])


def q_tukey_pairs_stats(spark, sf_dir):
    t = stats.tukey_pair_statistics(_enh_stats(spark, sf_dir), "lang", "art_word_perc")
    return _round_cols(t, ["meandiff", "se", "q", "df"])


def q_tukey_pairs(spark, sf_dir):
    return stats.tukey_hsd(_enh_stats(spark, sf_dir), "lang", "art_word_perc")


def q_pearson_lineitem(spark, sf_dir):
    p = stats.pearson(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return _round_cols(p, ["coefficient", "p_value"])


def q_group_ci_lineitem(spark, sf_dir):
    g = stats.group_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return _round_cols(g, ["mean", "sem", "ci_lower", "ci_upper"])


def q_anova_lineitem(spark, sf_dir):
    t = stats.anova_table(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_discount")
    return _round_cols(t, ["sum_sq", "df", "F", "PR(>F)"])


def q_stream_analyze(spark, sf_dir):
    """Documents arriving as a file stream, analysed per micro-batch (availableNow), read back."""
    from termlens.streaming.incremental import analyze_stream, read_document_stream, write_incremental

    # a pattern: the table may be one file or a folder of files, and a stream's plain path must be a folder
    stream = read_document_stream(spark, os.path.join(sf_dir, "{documents.parquet}"))
    out = analyze_stream(stream.select("doc_id", "text"), "text", _vocab(spark), enhanced=False)
    cols = [F.col("doc_id"), F.col("n_tokens"), F.col("n_types")]
    for c in CATEGORIES:
        cols += [F.col(f"{c}_word_count"), _r(F.col(f"{c}_word_perc")).alias(f"{c}_word_perc")]
    base = _scratch(spark)
    q = write_incremental(out.select(*cols), base + "/data", base + "/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(base + "/data")


def q_stream_term_totals(spark, sf_dir):
    """Documents arriving in four lots of files, their term totals kept as state and read at the end."""
    from termlens.streaming.incremental import read_document_stream, read_term_totals, running_term_totals

    base = _scratch(spark)
    lot = spark.sparkContext.defaultParallelism  # files at once: one for each core
    _docs(spark, sf_dir).select("doc_id", "text").repartition(4 * lot).write.parquet(base + "/in")
    stream = read_document_stream(spark, base + "/in", max_files_per_trigger=lot)
    running_term_totals(stream, "text", _vocab(spark), base + "/totals", base + "/checkpoint").awaitTermination()
    return read_term_totals(spark, base + "/totals")


# --------------------------------------------------------------------------- #
# types and formats as written, pages and chunks by position, thresholds, tables of a distribution
# --------------------------------------------------------------------------- #
def q_csv_infer_types(spark, sf_dir):
    """``documents`` with columns that look like truth values or numbers to a cast: their inferred types
    and values.  ``text`` holds line breaks and quotes."""
    from termlens.sources.datasets import read_dataset
    from termlens.sources.sinks import export

    i = F.col("doc_id")
    d = _docs(spark, sf_dir).select(
        "doc_id",
        "text",
        F.when(i % 2 == 0, "yes").otherwise("no").alias("yes_no"),
        F.when(i % 3 == 0, "t").otherwise("f").alias("t_f"),
        F.concat((i % 90).cast("string"), F.element_at(F.array(F.lit("d"), F.lit("f")), (i % 2 + 1).cast("int"))).alias("code"),
        F.when(i % 2 == 0, "True").otherwise("FALSE").alias("truth"),
        F.when(i % 5 != 0, (i % 7).cast("string")).alias("gaps"),
        F.concat((i % 8).cast("string"), F.lit("e"), (i % 5 - 2).cast("string")).alias("power"),
    )
    path = _scratch(spark) + ".csv"
    export(d, path, "csv")
    back = read_dataset(spark, path)
    kinds = F.lit(", ".join(f"{n} {t}" for n, t in back.dtypes))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "yes_no", "t_f", "code", "truth", "gaps", _r(F.col("power")).alias("power"), kinds.alias("types"))


def q_numbers_as_text(spark, sf_dir):
    """A numeric column analysed as text: every number as it is usually printed, and its tokens."""
    price, n = F.col("l_extendedprice").cast("double"), F.col("l_linenumber")
    value = F.when(n == 1, price * F.lit(1e12)).when(n == 2, price * F.lit(1e-9)).when(n == 3, F.floor(price).cast("double")).otherwise(price)
    rows = balance(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", value.alias("number"))
    # printed in a projection of its own: each number once
    printed = rows.select("l_orderkey", "l_linenumber", text_column_of(rows, "number").alias("printed"))
    return printed.select("l_orderkey", "l_linenumber", "printed", F.array_join(tokenize("printed"), "|").alias("tokens"))


def q_tokens_and_ngrams(spark, sf_dir):
    """The tokens of every document and its n-grams after them, as one list with repeats."""
    d = _spread_docs(spark, sf_dir).select("doc_id", tokenize(text_column_of(_docs(spark, sf_dir), "text")).alias("tk"))
    return d.select("doc_id", F.array_join(F.concat("tk", all_ngrams(F.col("tk"), ngram_orders(3))), "|").alias("terms"))


def q_xlsx_roundtrip(spark, sf_dir):
    """``documents`` in workbooks of one source and a thousand ids each, parsed again."""
    from termlens.sources.datasets import infer_types, mark_missing
    from termlens.sources.xlsx import read_workbooks, to_workbooks

    d = _docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars")
    name = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.lit(".xlsx"))
    return infer_types(mark_missing(read_workbooks(to_workbooks(d, name, ["doc_id"]))))


def q_indexed_pages(spark, sf_dir):
    """Three pages of one index over (source, doc_id), a deep one among them."""
    from termlens.operators.paging import PageIndex

    index = PageIndex.build(_docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), ["source", "doc_id"], rows_per_range=500)
    pages = [index.page(offset, limit).withColumn("page", F.lit(i)) for i, (offset, limit) in enumerate([(0, 20), (130, 40), (index.n_rows * 3 // 4, 60)])]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def q_export_chunks(spark, sf_dir):
    """The enhanced documents exported in ordered chunks of 300 rows: the manifest."""
    from termlens.operators.paging import export_chunks

    e = enhance(_docs(spark, sf_dir), "text", _vocab(spark, {"art": TEST_WORDLIST["art"]}))
    return export_chunks(e, _scratch(spark), ["source", "doc_id"], 300, "csv", rows_per_range=500).select("chunk", "rows", "first_key", "last_key")


def q_top_terms_threshold(spark, sf_dir):
    from termlens.operators.topk import top_terms_by_threshold

    return top_terms_by_threshold(_analysis(spark, sf_dir), 5)


def q_top_terms_threshold_by_docs(spark, sf_dir):
    from termlens.operators.topk import top_terms_by_threshold

    return top_terms_by_threshold(_enhanced(spark, sf_dir), 3, by="doc_frequency").drop("frequency")


def q_tukey_many_groups(spark, sf_dir):
    """All pairs of languages and sources by the size of their documents, in millions of characters."""
    d = _docs(spark, sf_dir).select(F.concat("lang", F.lit("/"), "source").alias("group"), (F.col("n_chars").cast("double") / 1e6).alias("size"))
    return stats.tukey_hsd(d, "group", "size")


def q_scatter_sample(spark, sf_dir):
    return stats.scatter_sample(table(spark, sf_dir, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_quantity", "l_extendedprice", "k", cells=16, per_cell=3)


def q_missing_detected_cells(spark, sf_dir):
    """Detected columns with null cells: they are skipped."""
    e = _enhanced(spark, sf_dir)
    cells = [F.when(F.col("doc_id") % 4 != i, F.col(f"{c}_detected_words")).alias(f"{c}_detected_words") for i, c in enumerate(CATEGORIES)]
    return corpus_term_frequencies(e.select("doc_id", *cells), CATEGORIES)


def q_json_records_nan(spark, sf_dir):
    """A page of records with numbers that are not numbers: JSON nulls."""
    d = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, float("nan")).when(F.col("doc_id") % 3 == 1, F.col("n_chars") / 2).alias("half"))
    return to_json_records(d, ["doc_id"], 0, 90)


def q_column_roles(spark, sf_dir):
    """Which columns serve as text, number and category, with the count of distinct values."""
    out = None
    for name in ("documents", "labels", "lineitem"):
        t = table(spark, sf_dir, name)
        roles = {"text": text_columns(t) if name != "labels" else [], "numeric": numeric_columns(t), "category": categorical_columns(t)}
        counts = t.agg(*[F.countDistinct(F.col(c)).alias(c) for c in t.columns])
        cells = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for r, cs in roles.items() for c in cs])
        one = counts.select(F.lit(name).alias("table_name"), F.explode(cells).alias("x")).select("table_name", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def q_vocab_summary_file_order(spark, sf_dir):
    """The wordlist's prefixes read from a file in another order than theirs: samples keep the file's."""
    from termlens.sources.datasets import read_wordlist
    from termlens.sources.sinks import export

    path = _scratch(spark) + ".dicx"
    prefixes = benchmark_wordlist(spark, sf_dir).where(F.col("DicTerm").endswith("*"))
    export(prefixes.coalesce(1).sortWithinPartitions(F.md5(F.col("DicTerm").cast("binary"))), path, "csv")
    return vocabulary_summary(vocabulary_from_wordlist(read_wordlist(spark, path))).select("category", "n_terms", "sample_terms")


def q_error_codes(spark, sf_dir):
    """The codes of errors over the given tables, one row for each misuse."""
    from termlens.errors import TermLensError
    from termlens.sources.datasets import read_dataset

    d, bench = _docs(spark, sf_dir), benchmark_wordlist(spark, sf_dir)
    cases = {
        "no DicTerm column": lambda: vocabulary_from_wordlist(bench.withColumnRenamed("DicTerm", "term")),
        "no category column": lambda: vocabulary_from_wordlist(bench.select("DicTerm")),
        "unknown category": lambda: _vocab(spark).select(["nope"]),
        "no text column": lambda: text_columns(table(spark, sf_dir, "labels")),
        "unknown column": lambda: select_columns(d, ["nope"]),
        "unsupported format": lambda: read_dataset(spark, os.path.join(sf_dir, "documents.docx")),
    }
    codes = {}
    for case, call in cases.items():
        try:
            call()
        except TermLensError as e:
            codes[case] = e.code
    rows = F.array(*[F.struct(F.lit(k).alias("misuse"), F.lit(codes.get(k)).alias("code")) for k in cases])
    return d.agg(F.count(F.lit(1)).alias("n_documents")).select("n_documents", F.explode(rows).alias("x")).select("x.misuse", "x.code", "n_documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_stats": q_tokenize_stats,
    "token_freq_by_lang": q_token_freq_by_lang,
    "ngram_bigrams_top": q_ngram_bigrams_top,
    "ngram_trigrams_top": q_ngram_trigrams_top,
    "clean_and_tokenize": q_clean_and_tokenize,
    "exact_single_counts": q_exact_single_counts,
    "prefix_single_counts": q_prefix_single_counts,
    "exact_multi_counts": q_exact_multi_counts,
    "prefix_multi_counts": q_prefix_multi_counts,
    "overlap_double_count": q_overlap_double_count,
    "analyze_wide": q_analyze_wide,
    "analyze_join_plan": q_analyze_join_plan,
    "word_perc": q_word_perc,
    "detected_long": q_detected_long,
    "detected_display": q_detected_display,
    "detected_parse": q_detected_parse,
    "term_matches": q_term_matches,
    "legacy_type_counts": q_legacy_type_counts,
    "category_select": q_category_select,
    "conversation_roles_analyze": q_conversation_roles_analyze,
    "corpus_term_freq": q_corpus_term_freq,
    "top_terms_one_category": q_top_terms_one_category,
    "top_terms_all_categories": q_top_terms_all_categories,
    "top_terms_by_docs": q_top_terms_by_docs,
    "enhance": q_enhance,
    "sanitized_columns": q_sanitized_columns,
    "enhanced_page": q_enhanced_page,
    "export_without_text": q_export_without_text,
    "csv_roundtrip": q_csv_roundtrip,
    "tsv_roundtrip": q_tsv_roundtrip,
    "parquet_roundtrip": q_parquet_roundtrip,
    "dataset_profile": q_dataset_profile,
    "dataset_preview": q_dataset_preview,
    "vocab_unpivot": q_vocab_unpivot,
    "vocab_merge": q_vocab_merge,
    "vocab_summary": q_vocab_summary,
    "vocab_head_tail": q_vocab_head_tail,
    "analyze_table_vocab": q_analyze_table_vocab,
    "pearson": q_pearson,
    "correlation_pairs": q_correlation_pairs,
    "ols_trend": q_ols_trend,
    "group_ci_t": q_group_ci_t,
    "group_ci_z": q_group_ci_z,
    "mean_bars": q_mean_bars,
    "anova_table": q_anova_table,
    "anova_labels": q_anova_labels,
    "tukey_pairs_stats": q_tukey_pairs_stats,
    "tukey_pairs": q_tukey_pairs,
    "pearson_lineitem": q_pearson_lineitem,
    "group_ci_lineitem": q_group_ci_lineitem,
    "anova_lineitem": q_anova_lineitem,
    "stream_analyze": q_stream_analyze,
    "page_after_key": q_page_after_key,
    "json_records_page": q_json_records_page,
    "select_columns": q_select_columns,
    "legacy_detected": q_legacy_detected,
    "top_terms_enhanced": q_top_terms_enhanced,
    "top_terms_by_docs_enhanced": q_top_terms_by_docs_enhanced,
    "corpus_terms_from_display": q_corpus_terms_from_display,
    "vocab_summary_empty_category": q_vocab_summary_empty_category,
    "vocab_head_tail_empty_category": q_vocab_head_tail_empty_category,
    "vocab_terms_for": q_vocab_terms_for,
    "vocab_union": q_vocab_union,
    "wordlist_formats": q_wordlist_formats,
    "csv_infer_na": q_csv_infer_na,
    "read_usecols_dtype": q_read_usecols_dtype,
    "analyze_large_vocab_nokey": q_analyze_large_vocab_nokey,
    "analyze_duplicate_and_null_keys": q_analyze_duplicate_and_null_keys,
    "anova_summary": q_anova_summary,
    "scatter_points": q_scatter_points,
    "stream_term_totals": q_stream_term_totals,
    "csv_infer_types": q_csv_infer_types,
    "numbers_as_text": q_numbers_as_text,
    "tokens_and_ngrams": q_tokens_and_ngrams,
    "xlsx_roundtrip": q_xlsx_roundtrip,
    "indexed_pages": q_indexed_pages,
    "export_chunks": q_export_chunks,
    "top_terms_threshold": q_top_terms_threshold,
    "top_terms_threshold_by_docs": q_top_terms_threshold_by_docs,
    "tukey_many_groups": q_tukey_many_groups,
    "scatter_sample": q_scatter_sample,
    "missing_detected_cells": q_missing_detected_cells,
    "json_records_nan": q_json_records_nan,
    "column_roles": q_column_roles,
    "error_codes": q_error_codes,
    "vocab_summary_file_order": q_vocab_summary_file_order,
}
