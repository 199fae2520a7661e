"""Exact top n-grams of every group in two passes over the tokens, without a shuffle of all n-grams.

1. Every task counts its n-grams into ``BUCKETS`` hashed buckets (one row for each is shuffled), and names
   the first k n-grams of every group in each of its chunks.  The sums of the latter give a lower bound of
   the group's k-th total; a bucket's sum is an upper bound of the total of each n-gram in it.
2. N-grams whose bucket reaches the bound of their group are counted exactly; the rest cannot be among
   the first k.

So what is shuffled does not grow with the number of different n-grams; were all of them equally
frequent, the second pass would count them all, and be right.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators.topk import kth_sum
from termlens.session import stage_table

BUCKETS = 1 << 18  # numbers that the driver sums up and sends to the tasks (2 MB)
CHUNK_TOKENS = 1 << 20  # tokens counted at once (a longer document makes a chunk of its own)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Grams:
    """The different (group, n-gram) of some documents, with occurrences and documents."""

    def __init__(self, group: pa.Array, words: pa.Array, offset: np.ndarray, n: int):
        coded, groups = words.dictionary_encode(), group.dictionary_encode(null_encoding="encode")
        self.words, self.groups = coded.dictionary, groups.dictionary
        token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.maximum(np.diff(offset) - (n - 1), 0)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) + np.repeat(offset[:-1] - (np.cumsum(size) - size), size)
        key, top = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64).take(row), len(self.groups)
        for k in range(n):
            if top * len(self.words) >= 1 << 62:  # renumbered, to stay within 64 bits
                different, key = np.unique(key, return_inverse=True)
                top = len(different)
            key, top = key * len(self.words) + token.take(at + k), top * len(self.words)
        order = np.argsort(key, kind="stable")  # documents stay in order
        key, row = key.take(order), row.take(order)
        new = np.diff(key, prepend=-1) != 0
        first = np.flatnonzero(new)
        self.occ = np.diff(np.append(first, len(key)))
        self.docs = np.add.reduceat((new | (np.diff(row, prepend=-1) != 0)).astype(np.int64), first) if len(first) else self.occ
        start = at.take(order.take(first))
        self.parts = [token.take(start + k) for k in range(n)]
        self.group = groups.indices.to_numpy(zero_copy_only=False).take(row.take(first))

    def bucket(self, buckets: int) -> np.ndarray:
        def hashes(values: pa.Array) -> np.ndarray:
            return np.array([zlib.crc32((x or "").encode()) for x in values.to_pylist()], np.uint64)

        h, words = hashes(self.groups).take(self.group), hashes(self.words)
        for part in self.parts:
            h = (h * _ODD) ^ (h >> np.uint64(29)) ^ words.take(part)
        return ((h * _ODD) >> np.uint64(40)).astype(np.int64) % buckets

    def batch(self, at: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
        term = pc.binary_join_element_wise(*[self.words.take(pa.array(p.take(at))) for p in self.parts], " ")
        group = self.groups.take(pa.array(self.group.take(at)))
        return pa.RecordBatch.from_arrays([group, term, *(pa.array(c.take(at)) for c in more.values())], names=["category", "term", *more])


def _chunks(batch: pa.RecordBatch, n: int, tokens: int) -> Iterator[_Grams]:
    rows, group = batch.column("tk"), batch.column("category").cast(pa.string())
    offset = rows.offsets.to_numpy().astype(np.int64)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(offset, offset[a] + tokens, "right")) - 1)
        yield _Grams(group.slice(a, b - a), rows.values.slice(offset[a], offset[b] - offset[a]).cast(pa.string()), offset[a : b + 1] - offset[a], n)
        a = b


def candidates(rows: DataFrame, n: int, k: int, buckets: int = BUCKETS, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(category, term, frequency, doc_frequency) in parts, of every n-gram that can be among the first ``k`` of its
    category.  ``rows``: (category, tk: array of tokens)."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for grams in _chunks(batch, n, tokens):
                total += np.bincount(grams.bucket(buckets), grams.occ, buckets).astype(np.int64)
                order = np.lexsort((-grams.occ, grams.group))
                begin = np.searchsorted(grams.group.take(order), grams.group.take(order))
                best = order[np.arange(len(order)) - begin < k]
                yield grams.batch(best, bucket=np.full(len(grams.occ), -1), s=grams.occ)
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(at), pa.array(total[at])], names=["category", "term", "bucket", "s"])

    sums = rows.select("category", "tk").mapInArrow(bounds, "category string, term string, bucket long, s long")
    sums = stage_table(sums.groupBy("category", "term", "bucket").agg(F.sum("s").alias("s")), "gram-bounds")
    least = {r["category"]: r["low"] or 0 for r in kth_sum(sums.where(F.col("bucket") < 0), k, "low").collect()}
    held = sums.where(F.col("bucket") >= 0).select("bucket", "s").toArrow()
    upper = np.zeros(buckets, np.int64)
    upper[held.column("bucket").to_numpy()] = held.column("s").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((upper, least))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, least = sent.value
        for batch in batches:
            for grams in _chunks(batch, n, tokens):
                low = np.array([least.get(g, 0) for g in grams.groups.to_pylist()], np.int64)
                yield grams.batch(np.flatnonzero(upper.take(grams.bucket(buckets)) >= low.take(grams.group)), frequency=grams.occ, doc_frequency=grams.docs)

    return rows.select("category", "tk").mapInArrow(reaching, "category string, term string, frequency long, doc_frequency long")


def top_ngrams(rows: DataFrame, n: int, k: int, **kw) -> DataFrame:
    """Top-k n-grams of every ``category`` of ``rows`` (category, tk: array of tokens), by frequency, then term:
    ``category, rank, term, frequency, doc_frequency``.  Rows without tokens have no n-gram; a null category is one."""
    exact = candidates(rows, n, k, **kw).groupBy("category", "term").agg(*[F.sum(m).cast("bigint").alias(m) for m in ("frequency", "doc_frequency")])
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("frequency"), F.asc("term")))
    return exact.withColumn("rank", place).where(F.col("rank") <= k).select("category", "rank", "term", "frequency", "doc_frequency")
