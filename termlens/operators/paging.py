"""Pages by position at a bounded cost (LIM-1), and exports in ordered chunks (SNK-2/5).

:class:`PageIndex` sorts a frame by ranges once and writes it with one folder for each range, next to a
small table of the ranges' row counts.  A page then reads the ranges that it touches and nothing else,
however deep it lies; the index is reused from page to page and from session to session.  Rows with
equal keys are split over ranges by a hash of the whole row, so no key fills a range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import UnsupportedFormatError, require_columns
from termlens.session import ensure_checkpoint_dir, remove_folder

ROWS_PER_RANGE = 100_000
RANGE, NTH, POSITION, CHUNK = "__tl_range", "__tl_nth", "__tl_position", "chunk"


def _tie(df: DataFrame) -> Column:
    """A hash of the row (its maps as text), for an order among equal keys that does not change."""
    cells = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*cells)


@dataclass(frozen=True)
class PageIndex:
    """``path``: the folder of the index; ``order_by``: the key columns (nulls first)."""

    spark: SparkSession
    path: str
    order_by: tuple[str, ...]

    @classmethod
    def build(cls, df: DataFrame, order_by: Sequence[str], path: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> PageIndex:
        """Sort ``df`` by ranges of about ``rows_per_range`` rows and write it under ``path`` (by default
        a new folder under the shared checkpoint folder).  The table of ranges is written last: an index
        without it is not complete and is refused by :meth:`open`."""
        require_columns(df.columns, list(order_by))
        spark = df.sparkSession
        path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        ranges = max(1, -(-df.count() // rows_per_range))
        order = [*[F.col(f"`{c}`") for c in order_by], _tie(df)]
        rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        # the id counts the rows of a task in its lower 33 bits
        rows = rows.withColumn(RANGE, F.spark_partition_id()).withColumn(NTH, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
        rows.write.mode("overwrite").partitionBy(RANGE).option("compression", "zstd").parquet(f"{path}/rows")
        written = spark.read.schema(_with_places(df.schema)).parquet(f"{path}/rows")
        counts = written.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy(RANGE)) - F.col("n")  # one row for each range
        counts.select(RANGE, "n", before.alias("begin")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return cls(spark, path, tuple(order_by))

    @classmethod
    def open(cls, spark: SparkSession, path: str, order_by: Sequence[str]) -> PageIndex:
        index = cls(spark, path, tuple(order_by))
        _ = index.n_rows  # fails without the table of ranges
        return index

    @property
    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    @property
    def n_rows(self) -> int:
        return self.ranges.agg(F.sum("n")).first()[0] or 0

    def rows(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """The rows at positions offset .. offset + limit, in no order, with their position."""
        if offset < 0 or (limit is not None and limit < 0):
            raise ValueError("offset/limit must be >= 0")
        touched = self.ranges.where(F.col("begin") + F.col("n") > offset)
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        rows = self.spark.read.schema(_with_places(columns)).parquet(f"{self.path}/rows")
        if limit is not None:
            touched = touched.where(F.col("begin") < offset + limit)
            # at most limit / rows_per_range + 2 of them: only their folders are listed and read
            rows = rows.where(F.col(RANGE).isin([r[RANGE] for r in touched.select(RANGE).collect()]))
        rows = rows.join(touched.select(RANGE, "begin"), RANGE).withColumn(POSITION, F.col("begin") + F.col(NTH)).drop("begin", RANGE, NTH)
        rows = rows.where(F.col(POSITION) >= offset)
        return rows if limit is None else rows.where(F.col(POSITION) < offset + limit)

    def page(self, offset: int = 0, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The page in key order (``columns``: of these columns)."""
        rows = self.rows(offset, limit)
        names = [c for c in rows.columns if c != POSITION]
        if columns:
            require_columns(names, list(columns))
            names = list(columns)
        return rows.orderBy(POSITION).select(*[F.col(f"`{c}`") for c in names])

    def remove(self) -> None:
        remove_folder(self.spark, self.path)


def _with_places(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(NTH, T.LongType()), T.StructField(RANGE, T.IntegerType())])


def export_chunks(
    df: DataFrame, path: str, order_by: Sequence[str], rows_per_chunk: int, fmt: str = "csv", exclude: Sequence[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Write ``df`` in key order as chunks of exactly ``rows_per_chunk`` rows (the last one may hold
    fewer): one file in each folder ``chunk=0``, ``chunk=1``, ...

    Returns the manifest (chunk, rows, first and last key as JSON), which is written to
    ``path/_manifest`` once all chunks are there; its absence says that an export is not complete.
    The sorted rows are staged in the shared folder and removed at the end.
    """
    from termlens.sources.sinks import SINK_FORMATS, render_nested, writer_of

    if rows_per_chunk < 1:
        raise ValueError("rows_per_chunk must be >= 1")
    if fmt.lower() not in SINK_FORMATS:
        raise UnsupportedFormatError(f"unsupported export format {fmt!r}; use one of {SINK_FORMATS}")
    index = PageIndex.build(df, order_by, rows_per_range=rows_per_range)
    rows = index.rows().withColumn(CHUNK, F.floor(F.col(POSITION) / rows_per_chunk).cast("long"))
    chunks = max(1, -(-index.n_rows // rows_per_chunk))
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in order_by]), {"ignoreNullFields": "false"})
    manifest = rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows"), F.min_by(key, POSITION).alias("first_key"), F.max_by(key, POSITION).alias("last_key"))
    names = [c for c in df.columns if c not in set(exclude or [])]
    # each chunk is sorted and written by one task
    dealt = rows.repartitionByRange(chunks, CHUNK).sortWithinPartitions(CHUNK, POSITION)
    dealt = dealt.select(*[F.col(f"`{c}`") for c in names], CHUNK)
    if fmt.lower() != "parquet":
        dealt = render_nested(dealt)
    writer_of(dealt.write.mode("overwrite").partitionBy(CHUNK), fmt.lower())(path)
    manifest.orderBy(CHUNK).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_manifest")
    index.remove()
    return df.sparkSession.read.schema(f"{CHUNK} long, rows long, first_key string, last_key string").json(f"{path.rstrip('/')}/_manifest")
