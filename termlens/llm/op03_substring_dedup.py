"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is cut into reference blocks at content-defined anchors: among the 8-word shingles of
each window of ``window`` words the one with the smallest hash is its anchor, and all windows with one
anchor make a block.  Equal passages are cut alike, so the blocks of the whole corpus, indexed by
hash, are what a document is factored against: a factor is a greedy run of blocks that occur
elsewhere.  At factor boundaries a block agrees only in part; there each window is looked up by
itself, among the blocks with the same anchor.  Factors of at least ``window`` words are the
duplicate spans, and their words are removed.  All windows of a block that occurs elsewhere do so
themselves, and a window can occur elsewhere only under its own anchor, so the result is exact (up
to equal hashes: blocks 64 bits, single windows 128 bits).

Texts are addressed by a 64-bit content hash.  Index entries are counted with partial aggregation,
so a passage that a third of all rows hold is one row per task.

Defined results: null and empty texts have no words; repeated rows are copies of each other, so all
their windows repeat; rows are judged one by one and ids may repeat or be null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import _BASE, chunks, keep, mix, span_hashes, table, utf8, word_hashes

WINDOW = 35
ANCHOR = 8
_PLACE = np.uint64((1 << 28) - 1)


def blocks(h: np.ndarray, offset: np.ndarray, window: int = WINDOW):
    """(text, first window, windows, anchor hash, block hash) of every reference block."""
    spans = window - ANCHOR + 1
    n = len(h)
    length = np.diff(offset)
    if n < window or not (length >= window).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    s = np.zeros(n - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        s = s * _BASE + h[j : j + len(s)]
    s = mix(s)
    low = (s & ~_PLACE) | np.arange(len(s), dtype=np.uint64)  # ties: the first place
    size = 1
    while size * 2 <= spans:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < spans:
        low = np.minimum(low[: len(low) - (spans - size)], low[spans - size :])
    valid = np.zeros(n + 1, np.int64)
    can = length >= window
    np.add.at(valid, offset[:-1][can], 1)
    np.add.at(valid, (offset[1:] - window + 1)[can], -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(low)] > 0)
    anchor = (low[start] & _PLACE).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    first, at = start[new], anchor[new]
    count = np.diff(np.append(np.flatnonzero(new), len(start)))
    text = np.searchsorted(offset, first, "right") - 1
    whole = span_hashes(h, first, first + count - 1 + window)
    block = mix(whole + (at - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return text, first - offset[text], count, s[at], block


def index_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: content hash, words, hash of all words, and its blocks as lists."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"), F.xxhash64(F.col(text)).alias("text_key"))

    def run(batches):
        for batch in batches:
            bodies = utf8(batch.column("body"))
            n_words, sha, lists = [], [], [[], [], [], []]
            for a, b in chunks(bodies, [len(t) for t in bodies]):
                h, offset = word_hashes(bodies[a:b])
                n_words += np.diff(offset).tolist()
                sha += [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in bodies[a:b]]
                where, *columns = blocks(h, offset, window)
                cut = np.searchsorted(where, np.arange(1, b - a))
                for out, c in zip(lists, columns, strict=True):
                    out += np.split(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32), cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), pa.array(sha, pa.string())]
                + [pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "text_key", "n_words", "sha", "start", "n", "anchor", "block"],
            )

    return rows.mapInArrow(run, "doc_id long, text_key long, n_words long, sha string, start array<int>, n array<int>, anchor array<long>, block array<long>")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """One row per different text; copies meet before the shuffle."""
    return docs.groupBy(F.xxhash64(F.col(text)).alias("text_key")).agg(F.first(F.col(text)).alias("body"))


def _window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """(text_key, at, h1, h2, open) of the windows of the listed blocks of every text."""

    def run(batches):
        for batch in batches:
            bodies, keys = utf8(batch.column("body")), batch.column("text_key").to_pylist()
            todo = batch.column("blocks").to_pylist()
            out = [[], [], [], [], []]
            for a, b in chunks(bodies, [len(t) for t in bodies]):
                h, offset = word_hashes(bodies[a:b])
                part = [(i, x["start"], x["n"], x["open"]) for i in range(a, b) for x in todo[i]]
                if not part:
                    continue
                i, start, n, free = (np.array(c) for c in zip(*part, strict=True))
                each = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat(i, n)
                place = each + offset[owner - a]
                out[0].append(np.array(keys, np.int64)[owner])
                out[1].append(each.astype(np.int32))
                out[2].append(mix(span_hashes(h, place, place + window)).view(np.int64))
                out[3].append(mix(span_hashes(mix(h ^ _BASE), place, place + window)).view(np.int64))
                out[4].append(np.repeat(free, n).astype(bool))
            kinds = (np.int64, np.int32, np.int64, np.int64, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *x]).astype(k)) for x, k in zip(out, kinds, strict=True)], names=["text_key", "at", "h1", "h2", "open"])

    return rows.mapInArrow(run, "text_key long, at int, h1 long, h2 long, open boolean")


def factors(docs: DataFrame, indexed: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(text_key, spans): per text with a repeated window, the runs (start, n) of such windows."""
    flat = indexed.select("text_key", F.explode(F.arrays_zip("start", "n", "anchor", "block")).alias("x")).select("text_key", "x.*")
    anchors = keep(flat.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    near = keep(flat.join(anchors, "anchor"), "blocks")
    seen = near.groupBy("block").agg(F.count("*").alias("c"), F.first(F.struct("text_key", "start", "n", "anchor")).alias("x")).select("block", "c", "x.*")
    seen = keep(seen, "index")
    # boundaries: blocks that occur once under an anchor that repeats, and what they may agree with
    loose = seen.where("c = 1").select("anchor").distinct()
    edge = seen.join(loose, "anchor", "left_semi").select("text_key", "start", "n", (F.col("c") == 1).alias("open"))
    edge = edge.groupBy("text_key").agg(F.collect_list(F.struct("start", "n", "open")).alias("blocks"))
    windows = keep(_window_hashes(_texts(docs, text).join(keep(edge, "edge"), "text_key"), window), "windows")
    twice = keep(windows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.max("open").alias("open")).where("c > 1 AND open").select("h1", "h2"), "repeated")
    single = windows.where("open").join(twice, ["h1", "h2"]).select("text_key", F.col("at").alias("start"), F.lit(1).alias("n"))
    again = keep(seen.where("c > 1").select("block"), "again")
    runs = near.join(again, "block").select("text_key", "start", "n").union(single).distinct()
    return runs.groupBy("text_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def kept_words(text: bytes, spans: list[tuple[int, int]], window: int = WINDOW) -> tuple[list[bytes], list[tuple[int, int]]]:
    """(words that stay, removed factors as (first word, words)): the runs joined where they meet."""
    words = text.split()
    cover = np.zeros(len(words) + 1, np.int64)
    for start, n in spans:
        cover[start] += 1
        cover[start + n - 1 + window] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, text_key, n_words, sha256 of its words), and for the texts with repeats
    (text_key, n_removed, kept_sha256, kept text, removed factors)."""
    indexed = keep(index_blocks(docs, key, text, window), "indexed")
    found = keep(factors(docs, indexed, text, window), "factors")

    def run(batches):
        for batch in batches:
            rows = [kept_words(t, [(s["start"], s["n"]) for s in x], window) for t, x in zip(utf8(batch.column("body")), batch.column("spans").to_pylist(), strict=True)]
            kept = [b" ".join(w) for w, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"),
                    pa.array([sum(n for _, n in f) for _, f in rows], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array([k.decode("utf-8", "replace") for k in kept]),
                    pa.array([[{"start": a, "n": n} for a, n in f] for _, f in rows], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))),
                ],
                names=["text_key", "n_removed", "kept_sha256", "kept", "factors"],
            )

    cut = _texts(docs, text).join(found, "text_key").mapInArrow(run, "text_key long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:long,n:long>>")
    return indexed.select("doc_id", "text_key", "n_words", "sha"), cut


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the words of repeated 35-word windows."""
    rows, cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = keep(cut.select("text_key", "n_removed", "kept_sha256", F.size("factors").alias("n_factors")), "cut")
    rows = rows.join(cut, "text_key", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_factors", F.lit(0)).alias("n_factors"))
