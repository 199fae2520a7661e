"""One scan of delimited text files by many tasks, also when cells hold line breaks (SRC-1/2).

Spark splits text files at line breaks, but a split may begin inside a quoted cell.  Quotes are doubled
in cells, so a line lies inside a cell exactly when an odd number of quotes stands before it:

1. A first pass counts the quotes of every split (one row for each: native, combined map-side).  If no
   line holds an odd number, no cell holds a line break and Spark's own line-wise reader is used.
2. Sums over the splits before give the state at the beginning of each split.  They are broadcast when
   their measured bytes are under ``BROADCAST_LIMIT_BYTES`` (some 40 TB of text in splits of 128 MB).
3. A second pass joins the lines of each record.  Only the pieces of records that cross an edge of a
   split (at most two for each) are shuffled, to be put together.
4. Records are parsed by Spark's CSV expression, like single lines.

Cells keep their line breaks as written; empty lines are skipped; the first record of every file is its
header.  Files with quotes where RFC 4180 allows none (``x"y``) are read by one task each, as Spark's
multi-line reader does; where such a quote shows only after the records are joined, it is an error that
names ``multiline="whole"``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import UnsupportedFormatError
from termlens.session import stage_table

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# a whole record; the end, the beginning, the inside of one that crosses edges; the beginning of a header
RECORD, HEAD, TAIL, MIDDLE, HEADER = range(5)
BOM = "\ufeff"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(path).select("value", *meta)


def _splits(lines: DataFrame, sep: str) -> DataFrame:
    """(path, start, quotes, broken, stray) of every split, with an id; written once."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    broken = (quotes % 2 == 1) | value.rlike(r"\r.")
    # without doubled quotes, each one opens a cell (after a separator) or closes one (before a separator)
    edge = "\t" if sep == "\t" else ","
    stray = F.replace(value, F.lit('""'), F.lit("")).rlike(rf'[^{edge}\uFEFF]"[^{edge}\r]')
    rows = lines.groupBy("path", "start").agg(F.sum(quotes).alias("quotes"), F.max(broken).alias("broken"), F.max((quotes > 0) & stray).alias("stray"))
    return stage_table(rows.withColumn("split", F.monotonically_increasing_id()), "splits")


def _assemble(sep: str):
    """Joins lines to records, in the order of each split."""
    schema = pa.schema([("kind", pa.int32()), ("split", pa.int64()), ("record", pa.string())])

    def checked(record: str) -> str:
        if '"' in record:
            parts = record.replace('""', "").split('"')
            outside = parts[::2]
            last = len(outside) - 1
            for i, p in enumerate(outside):
                if (i and p and p.strip("\r") and p[0] != sep) or (i < last and p and p[-1] not in (sep, BOM)):
                    raise ValueError(f'a quote outside a quoted cell; read this file with multiline="whole": {record[:200]!r}')
        return record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        split, inside, head, first, held = None, False, False, False, []

        def put(kind: int, text: str) -> None:
            out[0].append(kind)
            out[1].append(split)
            out[2].append(text)

        def leave() -> None:
            if held:
                put(MIDDLE if head else HEADER if first else TAIL, "\n".join(held))
                held.clear()

        for batch in batches:
            value = batch.column("value")
            odd = pc.bit_wise_and(pc.count_substring(value, '"'), 1).to_pylist()
            for text, here, begins_inside, opens, flips in zip(value.to_pylist(), batch.column("split").to_pylist(), batch.column("inside").to_pylist(), batch.column("opens").to_pylist(), odd):
                if here != split:
                    leave()
                    split, inside, head, first = here, begins_inside, begins_inside, opens
                held.append(text)
                inside ^= bool(flips)
                if inside:
                    continue
                record = held[0] if len(held) == 1 else "\n".join(held)
                held.clear()
                if head:
                    put(HEAD, record)
                    head = False
                elif record not in ("", "\r"):
                    if first:
                        first = False  # the header
                    else:
                        put(RECORD, checked(record))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for c in out:
                c.clear()
        leave()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _stitched(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Records that cross an edge of a split: each beginning with what follows it, in order."""
    pieces = stage_table(pieces, "pieces")
    where = pieces.select("split", "kind").join(splits.select("split", "path", "start"), "split")
    begins = F.col("kind").isin(TAIL, HEADER)
    order = Window.partitionBy("path").orderBy("start", begins)
    owner = F.last(F.when(begins, F.col("split")), ignorenulls=True).over(order)
    where = where.select("split", "kind", "start", owner.alias("owner"))
    piece = F.struct("start", (~begins).alias("later"), "record")
    rows = pieces.join(where, ["split", "kind"]).groupBy("owner").agg(F.array_sort(F.collect_list(piece)).alias("all"), F.max(F.col("kind") == HEADER).alias("header"))
    # a piece inside a record ends with its line, so pieces meet at line breaks
    return rows.where(~F.col("header")).select(F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))


def parsed(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """String columns of one record for each row (column ``record``)."""
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    cells = records.select(F.from_csv(F.regexp_replace("record", r"\r$", ""), F.lit(ddl), options).alias("row"))
    return cells.select(*[F.col("row").getField(n).alias(n) for n in names])


def scan(spark: SparkSession, path: str, sep: str, names: list[str]) -> DataFrame | None:
    """The rows under ``path`` as string columns ``names``, or ``None`` where a file needs one task."""
    lines = _lines(spark, path)
    splits = _splits(lines, sep)
    seen = splits.agg(
        F.max("broken").alias("broken"), F.max("stray").alias("stray"), F.sum(F.octet_length("path") + 64).alias("bytes"), F.count(F.lit(1)).alias("n")
    ).first()
    if not seen["n"]:
        raise UnsupportedFormatError(f"no lines under {path!r}")
    if seen["stray"] or seen["bytes"] > BROADCAST_LIMIT_BYTES:
        return None
    if not seen["broken"]:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("sep", sep).option("mode", "PERMISSIVE")
        return reader.option("enforceSchema", True).schema(schema).csv(path)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select("path", "start", "split", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    dealt = lines.join(F.broadcast(states), ["path", "start"]).select("value", "split", "inside", (F.col("start") == 0).alias("opens"))
    rows = dealt.mapInArrow(_assemble(sep), "kind int, split long, record string")
    whole = rows.where(F.col("kind") == RECORD).select("record")
    return parsed(whole.unionByName(_stitched(rows.where(F.col("kind") != RECORD), splits)), names, sep)
