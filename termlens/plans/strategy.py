"""Physical-plan choices the library makes before handing the plan to Catalyst.

* ``balance``: text analysis is CPU-bound per byte of text.  A scan of
  fewer and smaller files than the cluster has cores for (one big row group, a few
  files) would run it on a handful of cores, so such inputs are spread round-robin
  to ``spark.default.parallelism`` partitions, or more where each would take over ``TASK_BYTES``, so the
  longest task does not grow with the input.  Inputs that already give every core
  a full split -- any large table on a real cluster -- are left alone, so no
  shuffle is added at scale.
* Row-local vs join plan for the dictionary match: see
  :func:`termlens.operators.analyze.analyze` (literal count threshold) and
  :func:`termlens.operators.matches.term_matches` (broadcast only below a
  measured byte size, else a salted shuffle join).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TASK_BYTES = 16 << 20  # of files for one spread partition


def balance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread ``df`` round-robin when the files under it are fewer and smaller than the cluster's
    cores can work on: fewer files than cores, and fewer than one full split (the session's
    ``maxPartitionBytes``) for each core.  Frames without files (and streams) are returned unchanged.

    The order of rows is not kept.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < target:
        return df
    size = _bytes(spark, files)
    if size >= target * _split_bytes(spark):
        return df
    return df.repartition(max(target, -(-size // TASK_BYTES)))


def _bytes(spark, files: list[str]) -> int:
    """Total length of a few files, given as URLs (their contents are not read)."""
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in files]
    return spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0


def _split_bytes(spark) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}[unit]
