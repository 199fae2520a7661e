"""Enhanced dataset, column selection, paging, profile (PRJ-1..8, LIM-1/2, PRF-1).

The enhanced dataset is the analysed row itself: original columns first and
untouched, then the analysis columns, detected maps rendered as display
strings, and every name sanitised + uniquified.  No join: the analysis is a
projection of the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import NoTextColumnError, UnknownColumnError, require_columns
from termlens.functions.naming import sanitize_columns
from termlens.functions.text import DEFAULT_MAX_N, format_detected
from termlens.operators.analyze import DETECTED_SUFFIX, analyze
from termlens.operators.vocabulary import Vocabulary
from termlens.session import stage_table


def enhance(
    df: DataFrame,
    text_col: str,
    vocab: Vocabulary,
    max_n: int = DEFAULT_MAX_N,
    convention: str = "tokens",
    key_col: str | None = None,
    plan: str = "auto",
) -> DataFrame:
    """Analyse ``text_col`` and return the enhanced dataset (PRJ-1 + PRJ-2)."""
    analysed = analyze(df, text_col, vocab, max_n=max_n, convention=convention, key_col=key_col, plan=plan)
    return finalize_enhanced(analysed, n_original=len(df.columns), legacy=(convention == "types"))


def finalize_enhanced(analysed: DataFrame, n_original: int, legacy: bool = False) -> DataFrame:
    """Render detected maps as text and sanitise/uniquify all names (positional rename)."""
    cols = []
    for i, f in enumerate(analysed.schema.fields):
        c = F.col(f"`{f.name}`")
        if i >= n_original and f.name.endswith(DETECTED_SUFFIX) and isinstance(f.dataType, T.MapType):
            if legacy:
                # legacy list form: detected terms only, sorted, ", "-joined
                c = F.array_join(F.array_sort(F.map_keys(c)), ", ")
            else:
                c = format_detected(c)
        cols.append(c)
    return analysed.select(*cols).toDF(*sanitize_columns(analysed.columns))


def sanitized_name(df_columns: Sequence[str], original: str) -> str:
    """Where an original column ended up after sanitising (PRJ-5 deviation fix)."""
    mapping = dict(zip(df_columns, sanitize_columns(df_columns)))
    if original not in mapping:
        raise UnknownColumnError(f"unknown column {original!r}")
    return mapping[original]


def select_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """PRJ-3: select/reorder; unknown names are an error."""
    if not columns:
        return df
    require_columns(df.columns, list(columns))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_text(df: DataFrame, original_text_col: str, original_columns: Sequence[str]) -> DataFrame:
    """PRJ-5: drop the text column, mapped through the sanitiser first."""
    return df.drop(sanitized_name(original_columns, original_text_col))


def nan_to_null(df: DataFrame) -> DataFrame:
    """PRJ-6: NaN -> null in float columns (JSON has no NaN)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def page(df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """LIM-1: a stable page. The order key is mandatory (Spark rows have no position)."""
    if not order_by:
        raise ValueError("paging needs an order key")
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset/limit must be >= 0")
    view = select_columns(df, columns) if columns else df
    order = [F.col(f"`{c}`") for c in order_by]
    if offset and limit is None:
        return _after_position(view, order, offset)
    out = view.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def _after_position(df: DataFrame, order: list, offset: int) -> DataFrame:
    """All rows from position ``offset`` on in the given order, without a task that holds them all.

    The rows are range-sorted and written once; the row counts of the ranges (one number each) say
    at which position each range begins.
    """
    place, nth = "__tl_range", "__tl_nth"
    rows = df.orderBy(*order).withColumn(place, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id())
    rows = stage_table(rows, "ranges")
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(place).agg(F.count(F.lit(1)).alias("__tl_n"))
    begins = counts.select(place, F.coalesce(F.sum("__tl_n").over(before), F.lit(0)).alias("__tl_begin"))
    # the id counts the rows of a range in its lower 33 bits
    position = F.col("__tl_begin") + F.col(nth).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(begins, place).where(position >= offset).select(*[F.col(f"`{c}`") for c in df.columns]).orderBy(*order)


def page_after(df: DataFrame, order_by: Sequence[str], last: Sequence | None, limit: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The next ``limit`` rows after the row whose key values are ``last`` (``None``: from the start).

    Keyset paging: a filter that reaches the scan, and a top-k of ``limit`` rows however deep the
    page lies.  Nulls come first in key order, as in :func:`page`; the key must identify a row.
    """
    if last is not None:
        past, same = F.lit(False), F.lit(True)
        for name, value in zip(order_by, last, strict=True):
            c = F.col(f"`{name}`")
            past = past | (same & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))))
            same = same & c.eqNullSafe(F.lit(value))
        df = df.filter(past)
    return page(df, order_by, 0, limit, columns)


def enhanced_page(
    df: DataFrame, text_col: str, vocab: Vocabulary, order_by: Sequence[str], offset: int = 0, limit: int | None = None, **kw
) -> DataFrame:
    """A page of the enhanced dataset: the page is taken first and only its rows are analysed."""
    out = enhance(page(df, order_by, offset, limit), text_col, vocab, **kw)
    names = sanitize_columns(df.columns)
    return out.orderBy(*[F.col(f"`{names[df.columns.index(c)]}`") for c in order_by])


def to_json_records(df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """SNK-4: one JSON object per row for a page (``value`` column); missing values and NaN as null."""
    p = nan_to_null(page(df, order_by, offset, limit, columns))
    return p.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in p.columns]), {"ignoreNullFields": "false"}).alias("value"))


def text_columns(df: DataFrame) -> list[str]:
    """PRJ-7: string columns; error code ``no_text_column`` if none."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        raise NoTextColumnError("the dataset has no text column")
    return cols


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def profile(df: DataFrame) -> DataFrame:
    """PRF-1 as a table: ``(position, column_name, data_type, n_rows, n_null)``.

    One pass: all counts come from a single aggregate.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        missing = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        aggs.append(F.sum(F.when(missing, 1).otherwise(0)).alias(f"__m{i}"))
    counts = df.agg(*aggs)
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "position int, column_name string, data_type string",
    )
    stacked = counts.select(
        F.col("__n").cast("bigint").alias("n_rows"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"__m{i}").cast("bigint").alias("n_null")) for i in range(len(fields))])).alias("__s"),
    ).select("n_rows", "__s.position", "__s.n_null")
    return meta.join(F.broadcast(stacked), "position").select("position", "column_name", "data_type", "n_rows", "n_null")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """LIM-2: the first ``n`` rows in key order."""
    return page(df, order_by, 0, n)
