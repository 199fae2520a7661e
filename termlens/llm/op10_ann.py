"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations (ITQ on a bounded sample; several rotations
give more bits than dimensions).  A code is split into 8-bit substrings, each indexed.  Codes within
a Hamming radius R agree with the query in some substring up to R // substrings bits, so probing
those values of every substring retrieves every code within R; the codes decide, and the original
vectors rank what is left by inner product in double precision.  R is learned: the distance within
which nearly all true neighbours of the sample's vectors lie.  Fewer than k results widen it.

For inner products of vectors of any length, candidates get one more component that brings them to
the largest length.  Rows are dealt to shards of about ``SHARD`` rows, each with its index; the
stated queries stream past every shard in batches, and the best of all shards win.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components, or
whose dimension is not the most common one take no part, nor do rows without id; a query's own row
and rows with its id are no candidates; of query rows with one id the first vector in
order is asked; ties go to the smaller
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termlens.llm.common import keep, sample_share, table

SAMPLE = 4096  # rows that rotations and radius are learned on (expected number)
ROTATIONS = 4
SHARD = 8192
COVER = 0.98  # share of the sample's true neighbours that the radius holds
ITQ_ROUNDS = 20
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Coder:
    """Learned rotations and radius."""

    def __init__(self, sample: np.ndarray, norm: float, n: int, k: int, rotations: int = ROTATIONS):
        self.norm = norm
        x = self.lift(sample)
        d = x.shape[1]
        rng = np.random.default_rng(1013)
        self.rotation = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(ITQ_ROUNDS):
                u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (u @ v).T
            self.rotation.append(r)
        self.bits = -(-d * rotations // 8) * 8
        self.tables = self.bits // 8
        # the sample's neighbours at the depth that k of n rows have
        depth = max(1, min(len(x) - 1, -(-k * len(x) // max(1, n))))
        q = sample[:512]
        codes, probes = self.codes(sample), self.codes(q, query=True)
        self.radius = self.bits
        if len(sample) > 1:
            far = []
            for i in range(len(q)):
                s = sample @ q[i]
                s[i] = -np.inf
                top = np.argpartition(-s, depth - 1)[:depth]
                far += _BITS[codes[top] ^ probes[i]].sum(axis=1).tolist()
            self.radius = int(np.quantile(far, COVER, method="higher"))

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = self.lift(x, query)
        return np.packbits(np.hstack([x @ r >= 0 for r in self.rotation]), axis=1)


class MultiIndex:
    """The substring tables of one shard's codes; a bit for every row."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder):
        self.ids, self.x, self.codes, self.coder = ids, x, coder.codes(x), coder
        n = len(ids)
        reach = coder.radius // coder.tables
        within = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= reach
        self.ball = []
        for t in range(coder.tables):
            has = np.zeros((256, n), bool)
            has[self.codes[:, t], np.arange(n)] = True
            bucket = np.packbits(has, axis=1)
            self.ball.append(np.array([np.bitwise_or.reduce(bucket[within[v]], axis=0) for v in range(256)]))

    def search(self, query_id: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k within the radius, widened until there are k or no more rows."""
        hit = self.ball[0][code[0]].copy()
        for t in range(1, len(code)):
            hit |= self.ball[t][code[t]]
        rows = np.flatnonzero(np.unpackbits(hit, count=len(self.ids)))
        rows = rows[self.ids[rows] != query_id]
        far = _BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int32)
        near = rows[far <= self.coder.radius]
        if len(near) < k:  # sparse neighbourhood: the k nearest codes, with ties
            rows = np.flatnonzero(self.ids != query_id)
            far = _BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int32)
            near = rows if len(rows) <= k else rows[far <= np.partition(far, k - 1)[k - 1]]
        score = (self.x[near] * q).sum(axis=1)
        if len(near) > k:
            best = score >= np.partition(score, len(near) - k)[len(near) - k]
            near, score = near[best], score[best]
        order = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][order], score[order]


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row for which ``is_query`` (over ``key``) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("norm"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == common["d"])
    n, shards = common["n"], -(-common["n"] // shard_rows)
    sample = rows.where(sample_share("id", SAMPLE / n)).select("id", "x").collect() or rows.limit(SAMPLE).collect()
    sample = np.array([r["x"] for r in sorted(sample, key=lambda r: (r["id"], r["x"]))[: 2 * SAMPLE]])
    coder = spark.sparkContext.broadcast(Coder(sample, common["norm"], n, k))
    data = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "x")
    asked = rows.where("asks").groupBy("id").agg(F.min("x").alias("x"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "x")
    dealt = data.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")

    def run(batches):
        here, ids, xs, index = None, [], [], None
        for batch in batches:
            out = [[], [], []]
            x = batch.column("x")
            d = common["d"]
            at = x.offsets.to_numpy()
            x = x.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(-1, d)
            shard, kind, id_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "id"))
            code = coder.value.codes(x, query=True) if kind.any() else None
            for i in range(len(x)):
                if shard[i] != here:
                    here, ids, xs, index = shard[i], [], [], None
                if kind[i] == 0:
                    ids.append(id_[i])
                    xs.append(x[i].copy())
                    continue
                if not ids:
                    continue
                if index is None:
                    index = MultiIndex(np.array(ids), np.array(xs), coder.value)
                found, score = index.search(id_[i], x[i], code[i], k)
                out[0].append(np.full(len(found), id_[i]))
                out[1].append(found)
                out[2].append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
