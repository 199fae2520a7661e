"""Corpus-level detected-term reports (AGG-6, TOP-1, TOP-2, WIN-1, SRT-1, PLT-1).

Input is an analysis/enhanced frame: each ``{c}_detected_words`` column is a
``map<string,bigint>`` (or its display string).  Aggregation is
``explode -> groupBy(category, term)`` with ``sum``/``count``: both are
algebraic, so Spark combines map-side and a hot term (think "the") costs one
partial row per partition, not one row per document, in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import UnknownCategoryError
from termlens.functions.text import explode_rows, parse_detected

DETECTED_SUFFIX = "_detected_words"


def detected_categories(df: DataFrame) -> list[str]:
    """Categories whose detected column exists (PRJ-8: strip the suffix)."""
    return [c[: -len(DETECTED_SUFFIX)] for c in df.columns if c.endswith(DETECTED_SUFFIX)]


def _cells(df: DataFrame, col: str) -> "F.Column":
    """A detected column as ``array<struct<term, occ>>`` (map or display string, which can repeat a term)."""
    c = F.col(f"`{col}`")
    if isinstance(df.schema[col].dataType, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("term"), e["value"].cast("bigint").alias("occ")))
    return parse_detected(c)


def _one_per_term(pairs: "F.Column") -> "F.Column":
    """``pairs`` with one pair for each term: the sum of its counts.  Cells seldom repeat a term."""
    terms = F.array_distinct(F.transform(pairs, lambda p: p["term"]))
    total = lambda t: F.aggregate(F.filter(pairs, lambda p: p["term"] == t), F.lit(0).cast("bigint"), lambda a, p: a + p["occ"])
    return F.when(F.size(terms) == F.size(pairs), pairs).otherwise(F.transform(terms, lambda t: F.struct(t.alias("term"), total(t).alias("occ"))))


def detected_long(df: DataFrame, key_cols: Sequence[str], categories: Sequence[str] | None = None) -> DataFrame:
    """``(key..., category, term, occ)``: one row per detected term per row and category.

    Null cells are skipped (FLT-2).  A display string that repeats a term is
    summed within its cell, so no row key is needed.
    """
    cats = list(categories) if categories is not None else detected_categories(df)
    if not cats:
        return df.select(*key_cols).limit(0)
    # parsed in a projection of its own: each cell once
    cells = df.select(*[F.col(f"`{k}`") for k in key_cols], *[_cells(df, f"{c}{DETECTED_SUFFIX}").alias(f"__d{i}") for i, c in enumerate(cats)])
    # a map holds a term once, a display string may repeat it
    once = [F.col(f"__d{i}") if isinstance(df.schema[f"{c}{DETECTED_SUFFIX}"].dataType, T.MapType) else _one_per_term(F.col(f"__d{i}")) for i, c in enumerate(cats)]
    per_cat = F.array(*[F.struct(F.lit(c).alias("category"), p.alias("pairs")) for c, p in zip(cats, once, strict=True)])
    per = explode_rows(cells, [F.col(f"`{k}`") for k in key_cols], per_cat, "__c")
    exploded = explode_rows(per, [*key_cols, F.col("__c.category").alias("category")], F.col("__c.pairs"), "__p")
    return exploded.select(*key_cols, "category", F.col("__p.term").alias("term"), F.col("__p.occ").alias("occ"))


def corpus_term_frequencies(df: DataFrame, categories: Sequence[str] | None = None, row_key: str | None = None) -> DataFrame:
    """``(category, term, frequency, doc_frequency)`` over all rows (AGG-6).

    ``frequency`` sums occurrences, ``doc_frequency`` counts rows with the term.
    """
    cats = list(categories) if categories is not None else detected_categories(df)
    key = [row_key] if row_key else []
    long = detected_long(df if row_key else df.withColumn("__row", F.lit(0)), key or ["__row"], cats)
    return long.groupBy("category", "term").agg(
        F.sum("occ").cast("bigint").alias("frequency"),
        F.count(F.lit(1)).cast("bigint").alias("doc_frequency"),
    )


def top_terms(df: DataFrame, category: str, top_n: int = 10) -> DataFrame:
    """Top-N terms of ONE category by frequency desc, term asc (TOP-1, PLT-1)."""
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    if category not in detected_categories(df):
        raise UnknownCategoryError(f"unknown category {category!r}")
    freq = corpus_term_frequencies(df, [category])
    w = Window.partitionBy("category").orderBy(F.desc("frequency"), F.asc("term"))
    return (
        freq.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top_n)
        .select("rank", "term", "frequency", "doc_frequency")
    )


def top_terms_per_category(df: DataFrame, top_n: int = 10, by: str = "frequency", categories: Sequence[str] | None = None) -> DataFrame:
    """Top-N terms for EVERY category in one pass (WIN-1 / TOP-2 with ``by="doc_frequency"``).

    The window is partitioned by category over the *aggregated* term table;
    Spark plans it as a per-partition top-k (``WindowGroupLimit``) before the
    window, so a category with millions of terms never sorts them all in one task.
    """
    freq = corpus_term_frequencies(df, categories)
    w = Window.partitionBy("category").orderBy(F.desc(by), F.asc("term"))
    cols = ["category", "rank", "term", "frequency", "doc_frequency"] if by == "frequency" else ["category", "rank", "term", "doc_frequency"]
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).select(*cols)
