"""Sinks (SNK-1..5): CSV / TSV / Parquet / JSON written by Spark's partitioned writers.

Every executor writes its own part files; nothing is collected.  Map and
array columns are rendered as display strings for text formats (CSV has no
map type); Parquet keeps them native unless ``render_maps`` is set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import UnsupportedFormatError
from termlens.functions.text import format_detected

SINK_FORMATS = ("csv", "tsv", "parquet", "json")


def render_nested(df: DataFrame) -> DataFrame:
    """Map -> ``"k: v, ..."`` display string; array -> ``", "``-joined string."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            c = format_detected(c).alias(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def export(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    exclude: list[str] | None = None,
    mode: str = "overwrite",
    max_records_per_file: int | None = None,
    render_maps: bool = False,
) -> None:
    """Write ``df`` to ``path`` (a folder of part files) in ``fmt`` (SNK-1..3, SNK-5).

    ``max_records_per_file`` bounds each output file; for chunks of exact size in key order see
    :func:`termlens.operators.paging.export_chunks` (SNK-2).
    """
    fmt = fmt.lower()
    if fmt not in SINK_FORMATS:
        raise UnsupportedFormatError(f"unsupported export format {fmt!r}; use one of {SINK_FORMATS}")
    out = df.drop(*exclude) if exclude else df
    if fmt in ("csv", "tsv", "json") or render_maps:
        out = render_nested(out)
    w = out.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    writer_of(w, fmt)(path)


def writer_of(w: DataFrameWriter, fmt: str):
    """The writing method of ``fmt`` with the library's options, to be called with a path."""
    if fmt in ("csv", "tsv"):
        return (
            w.option("header", True)
            .option("sep", "," if fmt == "csv" else "\t")
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv
        )
    return w.parquet if fmt == "parquet" else w.json
