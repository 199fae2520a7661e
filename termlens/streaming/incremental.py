"""Incremental analysis of arriving documents with Structured Streaming.

The row-local analysis is a stateless projection, so the very same
``analyze`` plan runs on a streaming DataFrame: each micro-batch of new
documents is analysed and appended to a Parquet sink.  Exactly-once comes
from the sink's commit log plus the checkpoint folder (under the shared
``spark.checkpoint.dir``), so a restarted query resumes where it stopped.
:func:`running_term_totals` keeps the corpus's term totals as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termlens.functions.text import DEFAULT_MAX_N
from termlens.operators.analyze import analyze
from termlens.operators.detected import DETECTED_SUFFIX, detected_long
from termlens.operators.enhance import finalize_enhanced
from termlens.operators.vocabulary import Vocabulary


def read_document_stream(
    spark: SparkSession, folder: str, fmt: str = "parquet", glob: str | None = None, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A file stream of the documents landing in ``folder`` (optionally only files matching ``glob``).

    The schema is taken from the files present now (streams need it up front).
    """
    batch = spark.read.format(fmt)
    reader = spark.readStream.format(fmt)
    if glob:
        batch = batch.option("pathGlobFilter", glob)
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.schema(batch.load(folder).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def analyze_stream(stream: DataFrame, text_col: str, vocab: Vocabulary, max_n: int = DEFAULT_MAX_N, convention: str = "tokens", enhanced: bool = True) -> DataFrame:
    """The enhanced (or raw analysis) rows of a streaming DataFrame; row-local plan only
    (for more entries than it takes, :func:`analyze_arrivals`)."""
    if not stream.isStreaming:
        raise ValueError("analyze_stream expects a streaming DataFrame")
    out = analyze(stream, text_col, vocab, max_n=max_n, convention=convention, plan="rowlocal")
    return finalize_enhanced(out, len(stream.columns), legacy=(convention == "types")) if enhanced else out


def analyze_arrivals(
    stream: DataFrame, text_col: str, vocab: Vocabulary, path: str, checkpoint: str, available_now: bool = True, **kw
) -> StreamingQuery:
    """Analyse arriving documents against a dictionary of any size, one batch analysis per micro-batch.

    Each batch goes to its own folder ``path/batch=<id>``, written over when a batch is run again, so
    a restart repeats no row.  ``kw`` goes to :func:`termlens.operators.analyze.analyze`.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        analyze(batch, text_col, vocab, **kw).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def write_incremental(result: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch to Parquet at ``path`` (checkpointed, exactly-once)."""
    w = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_term_totals(
    stream: DataFrame, text_col: str, vocab: Vocabulary, path: str, checkpoint: str, max_n: int = DEFAULT_MAX_N, available_now: bool = True
) -> StreamingQuery:
    """Corpus totals of every detected term over all documents that have arrived (AGG-6 on arrivals).

    The totals are keyed state in the state store under ``checkpoint``; each micro-batch writes the
    totals that it changed to ``path/batch=<id>``, over what an interrupted run of it may have written.
    So a restarted query counts every document exactly once.  Read them with :func:`read_term_totals`.
    """
    analysed = analyze_stream(stream, text_col, vocab, max_n=max_n, enhanced=False)
    long = detected_long(analysed.select(F.lit(0).alias("__row"), *[c for c in analysed.columns if c.endswith(DETECTED_SUFFIX)]), ["__row"])
    totals = long.groupBy("category", "term").agg(F.sum("occ").cast("bigint").alias("frequency"), F.count(F.lit(1)).cast("bigint").alias("doc_frequency"))

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    w = totals.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_term_totals(spark: SparkSession, path: str) -> DataFrame:
    """The latest total of every term: ``category, term, frequency, doc_frequency``."""
    rows = spark.read.parquet(path)
    latest = [F.max_by(c, "batch").alias(c) for c in ("frequency", "doc_frequency")]
    return rows.groupBy("category", "term").agg(*latest)
