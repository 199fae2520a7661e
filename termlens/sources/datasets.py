"""Dataset and wordlist sources (SRC-1..10): format dispatch onto Spark readers.

Delimited files keep RFC-4180 quoting (text cells hold commas, quotes and
newlines).  One file is read by many tasks, also when its cells hold line breaks
(:mod:`termlens.sources.delimited`); Parquet is still the better format at scale,
as Spark prunes and filters it at the scan.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import UnsupportedFormatError, require_columns
from termlens.sources.delimited import scan

# Strings read as missing by default (the pandas reader's list).
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DATASET_FORMATS = {".csv": "csv", ".tsv": "tsv", ".xlsx": "xlsx", ".parquet": "parquet"}
WORDLIST_FORMATS = {".csv": "csv", ".dicx": "csv", ".tsv": "tsv", ".txt": "tsv", ".dic": "tsv", ".xlsx": "xlsx"}


def _suffix(path: str) -> str:
    base = path.rstrip("/").replace("\\", "/").rsplit("/", 1)[-1]
    return os.path.splitext(base)[1].lower()


def resolve_format(path: str, fmt: str | None, table: dict[str, str], kind: str) -> str:
    """Explicit ``fmt`` wins; else the (case-insensitive) suffix decides (SRC-6/7)."""
    if fmt:
        f = fmt.lower().lstrip(".")
        if f in set(table.values()) | {k.lstrip(".") for k in table}:
            return table.get("." + f, f)
        raise UnsupportedFormatError(f"unsupported {kind} format {fmt!r}")
    suf = _suffix(path)
    if suf not in table:
        raise UnsupportedFormatError(f"unsupported {kind} format {suf!r}: use one of {sorted(table)}")
    return table[suf]


def _delimited(spark: SparkSession, path: str, sep: str, names: Sequence[str] | None = None, multiline: bool | str = True, place: str | None = None) -> DataFrame:
    """A delimited file as string columns: short rows end in nulls, longer rows than the header are an error.

    ``multiline``: ``True`` splits files also when cells hold line breaks; ``False`` takes every line
    as a record (one pass less); ``"whole"`` reads each file by one task, with Spark's multi-line reader.
    ``place`` names a column with every row's place (file, start of its split, place in the order of its
    task), which needs ``multiline="whole"``.
    """
    if multiline not in (True, False, "whole"):
        raise ValueError(f"multiline is True, False or 'whole', not {multiline!r}")
    reader = (
        spark.read.option("header", True)
        .option("multiLine", bool(multiline))
        .option("quote", '"')
        .option("escape", '"')
        .option("sep", sep)
    )
    names = list(names) if names is not None else reader.option("inferSchema", False).csv(path).columns
    extra = "__tl_beyond_header"
    rows = scan(spark, path, sep, [*names, extra]) if multiline is True else None
    if rows is None:
        fields = [T.StructField(n, T.StringType()) for n in [*names, extra]]
        rows = reader.option("mode", "PERMISSIVE").option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
    if place:
        meta = F.col("_metadata")
        rows = rows.withColumn(place, F.struct(meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("nth")))
    message = F.concat(F.lit(f"a row of {path} has more than {len(names)} cells, the first beyond them: "), F.col(extra))
    fits = F.when(F.col(extra).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(fits).drop(extra)


# Cells that read as whole numbers, as numbers, and as truth values.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


def infer_types(df: DataFrame) -> DataFrame:
    """String columns as bigint, double or boolean where every value is written as one (one aggregate
    over the data); a column without values stays a string.

    Whole numbers beyond 64 bits and values such as ``yes``, ``t`` or ``12d`` are text; whole numbers
    among missing cells are doubles.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        kinds = {"n": c.isNotNull(), "bigint": c.rlike(INTEGER) & c.try_cast("bigint").isNotNull(), "whole": c.rlike(INTEGER), "double": c.rlike(NUMBER), "boolean": c.isin(*TRUTH)}
        parts += [F.count(F.when(test, True)).alias(f"{kind}{i}") for kind, test in kinds.items()]
    seen = df.agg(*parts).collect()[0]

    def kind_of(i: int) -> str | None:
        n = seen[f"n{i}"]
        if n and seen[f"whole{i}"] == n:
            return None if seen[f"bigint{i}"] < n else "bigint" if n == seen["rows"] else "double"
        return next((k for k in ("double", "boolean") if n and seen[f"{k}{i}"] == n), None)

    to = {n: kind_of(i) for i, n in enumerate(names)}
    return df.select(*[F.col(f"`{c}`").cast(to[c]).alias(c) if to.get(c) else F.col(f"`{c}`") for c in df.columns])


def mark_missing(df: DataFrame, na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """SRC-9: string cells equal to one of ``na_values`` become null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(list(na_values)), c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def read_dataset(
    spark: SparkSession,
    src: str | DataFrame,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    usecols: Sequence[str] | None = None,
    dtype: dict[str, str] | None = None,
    na_values: bool = True,
    multiline: bool | str = True,
    infer: bool = True,
) -> DataFrame:
    """Read a dataset: csv / tsv / xlsx / parquet path (file, folder or glob), or pass a DataFrame through.

    csv, tsv and xlsx cells are read as text; missing-value strings become null (unless
    ``na_values=False``) *before* types are given, so an ``NA`` in a column of numbers does not make
    it text.  ``schema`` gives all types and skips inference; ``dtype`` casts named columns (SRC-4);
    ``infer=False`` leaves the rest as text and saves a pass over the data.  ``usecols`` selects
    columns (Catalyst prunes the scan, SRC-5).  ``multiline``: see :func:`_delimited`.
    Parquet and DataFrames keep their types and values.
    """
    if isinstance(src, DataFrame):
        df, text_cells = src, False
    else:
        kind = resolve_format(src, fmt, DATASET_FORMATS, "dataset")
        text_cells = kind != "parquet"
        if kind == "parquet":
            df = spark.read.parquet(src) if schema is None else spark.read.schema(schema).parquet(src)
        elif kind == "xlsx":
            from termlens.sources.xlsx import read_xlsx

            df = read_xlsx(spark, src)
        else:
            df = _delimited(spark, src, "," if kind == "csv" else "\t", schema.fieldNames() if schema is not None else None, multiline)
    if text_cells and na_values:
        df = mark_missing(df)
    if usecols:
        require_columns(df.columns, list(usecols))
        df = df.select(*[F.col(f"`{c}`") for c in usecols])
    given = dict(dtype or {})
    require_columns(df.columns, list(given))
    if text_cells and schema is not None:
        given = {**{f.name: f.dataType for f in schema.fields if f.name in df.columns}, **given}
    elif text_cells and infer:
        typed = infer_types(df.select(*[F.col(f"`{c}`") for c in df.columns if c not in given])) if given else infer_types(df)
        given = {**{f.name: f.dataType for f in typed.schema.fields}, **given}
    if given:
        df = df.select(*[F.col(f"`{c}`").cast(given[c]).alias(c) if c in given else F.col(f"`{c}`") for c in df.columns])
    return df


def read_wordlist(spark: SparkSession, src: str | DataFrame, fmt: str | None = None) -> DataFrame:
    """Read a wide wordlist matrix with every cell as a string (SRC-8).

    ``.csv``/``.dicx`` are comma-separated; ``.tsv``/``.txt``/``.dic`` tab-separated; ``.xlsx`` workbook.
    Missing-value strings become null (so a literal ``NA`` term is skipped).  Rows of delimited files
    keep their place in the column ``ORDINAL``, for samples in the order of the files.
    """
    from termlens.operators.vocabulary import ORDINAL

    if isinstance(src, DataFrame):
        return src
    kind = resolve_format(src, fmt, WORDLIST_FORMATS, "wordlist")
    if kind == "xlsx":
        from termlens.sources.xlsx import read_xlsx

        df = read_xlsx(spark, src)
    else:
        df = _delimited(spark, src, "," if kind == "csv" else "\t", multiline="whole", place=ORDINAL)
    return mark_missing(df)
