"""Language identification by nearest centroid.

A text is a vector of hashed character 1-, 2- and 3-grams over letters (runs of other characters count
as one gap), weighted by 1+log(tf) and idf and normalised.  Each language has up to ``CENTROIDS``
centroids, found by spherical k-means on at most ``SAMPLE`` texts of the language; document
frequencies come from all training rows.  The nearest centroid by cosine gives the language; its
distance gives the score, and distances beyond what the centroid's own texts show are flagged.

The number of languages is taken to be small (each has a few centroids of ``DIMS`` numbers, the only
data sent to the executors).

Defined results: null text and text without a letter get ``und`` and score 0; repeated rows and ids
are judged one by one; ties go to the smaller language name; texts of any length are counted whole;
with no training row every text is ``und``; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import characters, chunks, id_crc, sample_share, table

DIMS = 4096
SAMPLE = 500  # training texts of a language that the centroids are fitted on (expected number)
CENTROIDS = 4
ROUNDS = 8
REJECT_SD = 4.0
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        c = characters(t)
        c = np.where(_LETTER[c], c, 0x20).astype(np.uint32)
        if len(c):
            c = c[np.append(True, (c[1:] != 0x20) | (c[:-1] != 0x20))]  # a gap is one space
        parts.append(np.concatenate([[0x20], c, [0x20, 0, 0]]).astype(np.uint32))
        owner.append(len(parts[-1]))
    c = np.concatenate(parts)
    row = np.repeat(np.arange(len(texts)), owner) * DIMS
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(13))) + c[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(11))) * np.uint32(0xC2B2AE35) + one[2:]
    keys = []
    for h, ok in ((one, c > 0x20), (two, c[1:] != 0), (three, c[2:] != 0)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        keys.append((row[: len(h)] + (h >> np.uint32(20)))[ok & (c[: len(h)] != 0)])
    return np.bincount(np.concatenate(keys), minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    centre = x[:1]
    while len(centre) < min(k, len(x)):  # farthest first
        centre = np.vstack([centre, x[(x @ centre.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        sums = [x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))]
        centre = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums], np.float32)
    return centre


def _parts(texts: list[str]):
    for a, b in chunks(texts, [len(t) + 4000 for t in texts], 1 << 20):
        yield a, b, gram_counts(texts[a:b])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centre: np.ndarray, owner: np.ndarray, limit: np.ndarray):
        self.langs, self.idf, self.centre, self.owner, self.limit = langs, idf, centre, owner, limit

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, reject = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        able = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for a, b, counts in _parts([texts[i] for i in able]):
            cosine = vectors(counts, self.idf) @ self.centre.T
            best = cosine.argmax(axis=1)
            for j, i in enumerate(able[a:b]):
                lang[i] = self.langs[self.owner[best[j]]]
                score[i] = min(1.0, max(0.0, round(float(cosine[j, best[j]]), 6)))
                reject[i] = 1 - score[i] > self.limit[best[j]]
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": reject})


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on the rows of ``docs`` for which ``learn`` holds and both text and language are given."""
    rows = docs.where(learn).select(F.col(key).alias("key"), F.col(text).alias("body"), F.col(lang).alias("lang")).where("body IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = [t for t in batch.column("body").to_pylist() if has_letter(t)]
            for _, _, counts in _parts(texts):
                total += (counts > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, total))], names=["slot", "n"])

    # one row per slot and task: DIMS + 1 rows on the driver
    counted = rows.select("body").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    df = np.zeros(DIMS + 1)
    for r in counted.collect():
        df[r["slot"] + 1] = r["n"]
    idf = np.log((df[0] + 1) / (df[1:] + 1)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    chosen = F.lit(False)
    for x in langs:
        chosen = chosen | ((F.col("lang") == x) & sample_share("key", SAMPLE / sizes[x]))

    def sparse(batches):
        for batch in batches:
            texts, names, idx, val = batch.column("body").to_pylist(), batch.column("lang").to_pylist(), [], []
            for _, _, counts in _parts(texts):
                for v in vectors(counts, idf):
                    idx.append(np.flatnonzero(v).astype(np.int32))
                    val.append(v[idx[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "idx", "val"])

    sample = rows.where(chosen).select("lang", "body").mapInArrow(sparse, "lang string, idx array<int>, val array<float>").collect()
    centre, owner, limit = [], [], []
    for i, x in enumerate(langs):
        own = sorted((r["idx"], r["val"]) for r in sample if r["lang"] == x)[: 2 * SAMPLE]
        if not own:  # a tiny language whose rows the share missed
            own = [(r["idx"], r["val"]) for r in rows.where(F.col("lang") == x).limit(SAMPLE).select("lang", "body").mapInArrow(sparse, "lang string, idx array<int>, val array<float>").collect()]
        m = np.zeros((len(own), DIMS), np.float32)
        for j, (a, b) in enumerate(own):
            m[j, a] = b
        c = _spherical_kmeans(m, CENTROIDS)
        far = 1 - m @ c.T
        for j in range(len(c)):
            d = far[far.argmin(axis=1) == j, j]
            limit.append(float(d.mean() + REJECT_SD * d.std()) if len(d) > 1 else 1.0)
        centre.append(c)
        owner += [i] * len(c)
    return Model(langs, idf, np.vstack(centre) if centre else np.zeros((0, DIMS), np.float32), np.array(owner, int), np.array(limit))


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return sent.value.predict([t if isinstance(t, str) else None for t in texts])

    return docs.withColumn(out, predict(docs[text]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows whose id's crc32 is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc("doc_id") % 3 == 1
    model = train(docs, ~held_out)
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
