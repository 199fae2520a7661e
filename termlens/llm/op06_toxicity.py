"""Toxicity from the nearest labelled examples.

Two searches judge a text.  The first is over all words of the labelled sample: every example and every
text with such a word is a TF-IDF vector over all its words, and its ``K`` nearest examples are exact by
cosine (words of all texts are counted for the document frequencies; words in no example match nothing, and
count in a text's norm with the weight of a word that none of the examples holds).  Its votes are weighted by the squared inverse distance, so a near copy outweighs chance
neighbours, and are drawn towards the label rate more strongly where no near copy is among them.  It decides if the text holds no chosen term, or if the nearest example is a near copy
(cosine of ``COPY`` or more); the second search, over chosen terms, decides for all others.

Terms are chosen by the likelihood ratio of their association with the label, and its factor, in a bounded
sample of the training rows; documents are TF-IDF vectors over these terms, with document frequencies counted over all
documents.  The labelled sample is an inverted index whose postings lie in blocks of ``BLOCK``
examples, each with the largest weight of every term.  A query visits blocks by falling upper bound
until no block can hold a nearer example, so its ``K`` nearest are exact by cosine.  Votes are weighted by
distance and drawn towards the label rate of the sample, which calibrates the score; votes for texts
without a chosen term are drawn towards the label rate of such examples, and a text that shares no word with
any example gets that rate.  The nearest examples are returned as evidence.

Defined results: null and empty texts are texts without terms; several labels of one id count as the
highest; labels without a document and null labels are not learned; repeated rows are judged one by
one; ties between examples go by their content (ids decide nothing); very long texts are searched whole;
with no training row the score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import chunks, id_crc, keep, sample_share, table, word_hashes

SAMPLE = 20_000  # labelled rows that the classifier is fitted on (expected number)
TERMS = 2_000
ALPHA = 1e-4  # chance that any term is chosen by accident
LIFT = 3.0  # its share among one label's examples, as a multiple of its share among the other's
BLOCK = 64
K = 15
PRIOR = 0.5  # votes' worth of the sample's label rate
COPY = 0.8  # cosine over all words from which an example is a near copy
COMMON = 256  # words of the most examples, whose weights lie in a dense matrix
TOGETHER = 64  # texts that are searched at once
_BREAK = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAK).split()


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, count) of the distinct words of all texts, by text and hash."""
    h, offset = word_hashes([(t or "").lower().encode("utf-8", "surrogatepass").translate(_BREAK) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(offset))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)])
    return owner[first], h[first], np.diff(np.append(first, len(h)))


def _squeeze(x: np.ndarray) -> tuple[str, bytes]:
    """Differences of neighbours (modulo the type), their bytes by place, compressed."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return x.dtype.str, zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _widen(packed: tuple[str, bytes]) -> np.ndarray:
    kind, data = np.dtype(packed[0]), np.frombuffer(zlib.decompress(packed[1]), np.uint8)
    return np.cumsum(np.ascontiguousarray(data.reshape(kind.itemsize, len(data) // kind.itemsize).T).view(kind).reshape(-1), dtype=kind)


class Space:
    """All words of all examples: exact nearest examples by the cosine of full TF-IDF vectors.

    Postings hold the rarer words; the weights of the ``COMMON`` words of the most examples are a dense
    matrix, so that their long postings cost one product for many texts.
    """

    def __init__(self, words: np.ndarray, idf: np.ndarray, ids: list, label: np.ndarray, sizes: np.ndarray, slot: np.ndarray, count: np.ndarray):
        """The examples hold ``sizes`` words each: word ``slot`` (of the sorted hashes ``words``) ``count`` times."""
        self.words, self.idf, self.ids, self.label, self.n = words, idf, ids, label, len(ids)
        self.sizes, self.slot, self.count = sizes, slot, count
        # the weight of a word that no example holds, as if the examples were all texts: with it a text's
        # norm covers the whole text, and one common word does not make a long text a copy of a short one
        self.unseen = math.log(self.n + 1) + 1
        self.matrix = None

    def __getstate__(self):
        """What is sent: the bags alone, squeezed (each worker makes its own index)."""
        return [self.idf, self.ids, self.label] + [_squeeze(x) for x in (self.words, self.sizes, self.slot, self.count)]

    def __setstate__(self, state):
        idf, ids, label, *bags = state
        words, sizes, slot, count = (_widen(x) for x in bags)
        self.__init__(words, idf, ids, label, sizes, slot, count)

    def _index(self) -> None:
        owner, slot = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes), self.slot
        w = self.weights(owner, slot, self.count, self.n)
        held = np.bincount(slot, minlength=len(self.words))
        common = np.argsort(-held, kind="stable")[:COMMON]
        self.row = np.full(len(self.words), -1, np.int32)
        self.row[common] = np.arange(len(common))
        dense = self.row[slot] >= 0
        self.matrix = np.zeros((len(common), self.n))
        self.matrix[self.row[slot[dense]], owner[dense]] = w[dense]
        owner, slot, w = owner[~dense], slot[~dense], w[~dense]
        order = np.argsort(slot, kind="stable")
        self.at, self.weight = owner[order], w[order]
        self.first = np.append(0, np.cumsum(np.bincount(slot, minlength=len(self.words))))

    def weights(self, owner: np.ndarray, slot: np.ndarray, count: np.ndarray, n: int, rest: np.ndarray | float = 0.0) -> np.ndarray:
        """Weights of the known words by the norm of all; ``rest``: the squares of the unseen ones."""
        w = (1 + np.log(count)) * self.idf[slot]
        return w / np.sqrt(np.maximum(np.bincount(owner, w * w, n) + rest, 1e-24))[owner]

    def nearest(self, texts: list[str | None], k: int = K) -> list[list[tuple[float, int]]]:
        """(cosine, example number) of the k nearest with a common word, nearest first, for each text."""
        if not len(self.words):
            return [[] for _ in texts]
        if self.matrix is None:
            self._index()
        out = []
        for a in range(0, len(texts), TOGETHER):
            out += self._nearest(texts[a : a + TOGETHER], k)
        return out

    def _nearest(self, texts: list[str | None], k: int) -> list[list[tuple[float, int]]]:
        owner, h, count = bags(texts)
        slot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[slot] == h
        rest = np.bincount(owner[~known], ((1 + np.log(count[~known])) * self.unseen) ** 2, len(texts))
        owner, slot, count = owner[known], slot[known], count[known]
        w = self.weights(owner, slot, count, len(texts), rest)
        dense = self.row[slot] >= 0
        left = np.zeros((len(texts), len(self.matrix)))
        left[owner[dense], self.row[slot[dense]]] = w[dense]
        cosine = left @ self.matrix
        owner, slot, w = owner[~dense], slot[~dense], w[~dense]
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for i in range(len(texts)):
            mine = slice(cut[i], cut[i + 1])
            begin, size = self.first[slot[mine]], self.first[slot[mine] + 1] - self.first[slot[mine]]
            p = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            s = cosine[i]
            s += np.bincount(self.at[p], self.weight[p] * np.repeat(w[mine], size), self.n)
            near = np.argpartition(s, self.n - k)[self.n - k :] if self.n > k else np.arange(self.n)
            if self.n > k:  # all that may tie with the last one
                near = np.flatnonzero(s >= s[near].min() - 1e-9)
            c = np.round(np.minimum(1.0, s[near]), 9)
            best = np.lexsort((near, -c))[:k]
            out.append([(x, n) for x, n in zip(c[best].tolist(), near[best].tolist(), strict=True) if x > 0])
        return out


class Examples:
    """The block-max inverted index of the labelled sample."""

    def __init__(self, terms: dict[bytes, int], idf: np.ndarray, rows: list[tuple[int, int, dict[int, int]]]):
        self.terms, self.idf = terms, idf
        # by content, which breaks ties; ids only tell equal examples apart
        rows = sorted(rows, key=lambda r: (sorted(r[2].items()), r[1], r[0] is None, r[0] or 0))
        empty = [y for _, y, v in rows if not v]
        rows = [r for r in rows if r[2]]
        self.ids, self.label = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        self.rate = (float(self.label.sum()) + sum(empty)) / max(1, len(rows) + len(empty))
        self.blank = (sum(empty) + self.rate) / (len(empty) + 1)
        blocks = -(-len(rows) // BLOCK)
        post: list[list[tuple[int, float]]] = [[] for _ in terms]
        for n, (_, _, v) in enumerate(rows):
            t, w = self.vector(v)
            for a, b in zip(t, w, strict=True):
                post[a].append((n, b))
        self.at = [np.array([n for n, _ in p], np.int64) for p in post]
        self.weight = [np.array([w for _, w in p]) for p in post]
        self.cut = [np.searchsorted(a, np.arange(blocks + 1) * BLOCK) for a in self.at]
        self.top = np.zeros((len(terms), blocks))
        for t in range(len(terms)):
            np.maximum.at(self.top[t], self.at[t] // BLOCK, self.weight[t])
        self.memo: dict = {}
        self.space: Space | None = None

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        w = np.array([1 + math.log(counts[i]) for i in t]) * self.idf[t]
        return t, w / max(np.linalg.norm(w), 1e-12)

    def counts(self, text: str | None) -> dict[int, int]:
        terms = self.terms
        return dict(Counter(terms[w] for w in words(text) if w in terms)) if text else {}

    def nearest(self, counts: dict[int, int], k: int = K) -> list[tuple[float, int]]:
        """(cosine, example number) of the k nearest with a common term, nearest first."""
        t, q = self.vector(counts)
        bound = q @ self.top[t]
        order = np.argsort(-bound, kind="stable")
        near = np.zeros(0, np.int64)
        cosine = np.zeros(0)
        done = 0
        while done < len(order) and bound[order[done]] > 0:
            if len(near) == k and bound[order[done]] < cosine[-1] - 1e-9:
                break  # no block left can hold a nearer example
            # a few blocks first; then all that can still matter at once
            least = cosine[-1] - 1e-9 if len(near) == k else 0.0
            count = 8 if not done else max(8, int((bound >= least).sum()) - done)
            use = np.zeros(len(order), bool)
            use[order[done : done + count]] = True
            done += count
            at, weight = [], []
            for a, w in zip(t.tolist(), q.tolist(), strict=True):
                mine = use[self.at[a] // BLOCK]
                at.append(self.at[a][mine])
                weight.append(w * self.weight[a][mine])
            at, slot = np.unique(np.concatenate(at), return_inverse=True)
            near = np.concatenate([near, at])
            cosine = np.concatenate([cosine, np.round(np.minimum(1.0, np.bincount(slot, np.concatenate(weight), len(at))), 12)])
            best = np.lexsort((near, -cosine))[:k]
            near, cosine = near[best], cosine[best]
        return list(zip(cosine.tolist(), near.tolist(), strict=True))

    def judge(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """Score and evidence of every text, by the search that decides (see the module)."""
        out = []
        for text, near in zip(texts, self.space.nearest(texts) if self.space else [[]] * len(texts), strict=True):
            chosen = bool(self.counts(text))
            if not near or chosen and near[0][0] < COPY:
                out.append(self.score(text))
                continue
            vote = [(1 / (0.1 + 1 - s) ** 2, n) for s, n in near]
            total = sum(v for v, _ in vote)
            unit = total / len(vote) * PRIOR
            if near[0][0] < COPY:  # far examples alone, however few, weigh less than the rate
                unit = max(unit, PRIOR / (0.1 + 1 - COPY) ** 2)
            yes = sum(v * self.space.label[n] for v, n in vote) + unit * (self.rate if chosen else self.blank)
            out.append((round(yes / (total + unit), 6), [self.space.ids[n] for _, n in near[:3]]))
        return out

    def score(self, text: str | None) -> tuple[float, list]:
        """By the chosen terms alone."""
        counts = self.counts(text)
        if not counts:
            return round(self.blank, 6), []
        key = tuple(sorted(counts.items()))
        if key not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            near = self.nearest(counts)
            vote = [(1 / (0.1 + 1 - s), n) for s, n in near]
            total = sum(v for v, _ in vote)
            unit = total / max(1, len(vote)) * PRIOR if vote else 1.0
            yes = sum(v * self.label[n] for v, n in vote)
            self.memo[key] = (round((yes + unit * self.rate) / (total + unit), 6), [self.ids[n] for _, n in near[:3]])
        return self.memo[key]


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Examples:
    """Fit on the labelled rows of ``docs`` for which ``learn`` (over ``key``) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), learn.alias("learn"))
    known = known.where(sample_share("key", SAMPLE / max(1, known.count())))
    # the sample has about SAMPLE ids, whatever the size of the table: a bounded broadcast
    sample = keep(rows.where("learn").join(F.broadcast(known), "key").select("key", "y", "body", F.xxhash64("body").alias("text_hash")), "labelled")

    def associations(batches):
        for batch in batches:
            n = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column("body").to_pylist(), batch.column("y").to_pylist(), strict=True):
                w = words(t or "")
                n[int(y > 0)].update(set(zip(w, [b"", *w], strict=False)))
            every = list(n[0].keys() | n[1].keys())
            columns = [pa.array([w[i] for w in every], pa.binary()) for i in (0, 1)] + [pa.array([n[y][w] for w in every], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "last", "yes", "no"])

    size = {r["y"]: r["n"] for r in sample.dropDuplicates(["text_hash", "y"]).groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    # A family of near copies shows a word after the same word again and again, so the label that a
    # word speaks for counts only as many examples as there are different words before it.
    for_yes = F.col("yes") * neg > F.col("no") * pos
    a, b = F.when(for_yes, F.col("yes_after")).otherwise(F.col("yes")), F.when(for_yes, F.col("no")).otherwise(F.col("no_after"))
    a, b = F.least(a, F.lit(pos)), F.least(b, F.lit(neg))
    c, d = F.lit(pos) - a, F.lit(neg) - b
    every = F.lit(float(pos + neg))
    cells = ((a, (a + b) * pos), (b, (a + b) * neg), (c, (c + d) * pos), (d, (c + d) * neg))
    ratio = sum((F.when(o > 0, 2 * o * F.log(o * every / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    # (half an example more on each side, so that a share of nothing can be compared)
    lift = ((a + 0.5) / F.lit(pos + 1.0)) / ((b + 0.5) / F.lit(neg + 1.0))
    once = sample.dropDuplicates(["text_hash", "y"])  # copies of a text are one piece of evidence
    scored = once.select("body", "y").mapInArrow(associations, "word binary, last binary, yes long, no long").groupBy("word", "last").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    scored = scored.groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.count_if(F.col("yes") > 0).alias("yes_after"), F.count_if(F.col("no") > 0).alias("no_after"))
    scored = keep(scored, "associations")
    # so many words are tested that chance alone must be ruled out for all of them together
    least = 2 * math.log(max(1, scored.count()) / ALPHA)
    scored = scored.withColumn("ratio", ratio).where((F.col("ratio") >= least) & ((lift >= LIFT) | (lift <= 1 / LIFT)))
    chosen = scored.orderBy(F.desc("ratio"), "word").limit(TERMS).collect()
    terms = {bytes(w): i for i, w in enumerate(sorted(bytes(r["word"]) for r in chosen))}

    def frequencies(batches):
        n, df = 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                if t:
                    for w in terms.keys() & set(words(t)):
                        df[terms[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms))), pa.array(np.append(n, df))], names=["slot", "n"])

    idf = np.ones(len(terms))
    if terms:
        df = {r["slot"]: r["n"] for r in rows.select("body").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
        idf = np.array([math.log((df[-1] + 1) / (df[i] + 1)) + 1 for i in range(len(terms))])

    def examples(batches):
        for batch in batches:
            v = [Counter(terms[w] for w in words(t or "") if w in terms) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").cast(pa.int64()), batch.column("y"), pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array([list(x.values()) for x in v], pa.list_(pa.int32()))],
                names=["key", "y", "term", "n"],
            )

    got = sample.select("key", "y", "body").mapInArrow(examples, "key long, y int, term array<int>, n array<int>").collect()
    found = Examples(terms, idf, [(r["key"], int(r["y"] > 0), dict(zip(r["term"], r["n"], strict=True))) for r in got])
    found.space = space(sample, rows)
    return found


def space(sample: DataFrame, rows: DataFrame) -> Space:
    """All words of the labelled ``sample`` (key, y, body), with document frequencies from all ``rows`` (body)."""

    def vectors(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            for a, b in chunks(texts, [len(t or "") for t in texts]):
                owner, h, count = bags(texts[a:b])
                cut = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
                word, n = pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32)))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("key").cast(pa.int64()), rows.column("y"), word, n], names=["key", "y", "word", "n"])

    got = sample.select("key", "y", "body").mapInArrow(vectors, "key long, y int, word array<long>, n array<int>")
    got = got.toArrow().combine_chunks()
    sizes = got.column("word").combine_chunks().value_lengths().to_numpy().astype(np.uint32)
    word = got.column("word").combine_chunks().flatten().to_numpy().view(np.uint64)
    count = got.column("n").combine_chunks().flatten().to_numpy().astype(np.uint32)
    # examples by content, which breaks ties, whatever order the rows came in
    at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    total = np.append(np.uint64(0), np.cumsum(word * (2 * count.astype(np.uint64) + np.uint64(1))))
    keys, label = got.column("key").to_numpy(), got.column("y").to_numpy() > 0
    order = np.lexsort((keys, label, total[at[1:]] - total[at[:-1]]))
    move = np.arange(len(word)) + np.repeat(at[:-1][order] - np.append(0, np.cumsum(sizes[order], dtype=np.int64))[:-1], sizes[order])
    word, count, sizes, keys, label = word[move], count[move], sizes[order], keys[order].tolist(), label[order].astype(float)
    del got, total, move
    words, slot = np.unique(word, return_inverse=True)
    slot = slot.astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def frequencies(batches):
        known = sent.value
        n, df = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            n += batch.num_rows
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, [len(t or "") for t in texts]) if len(known) else ():
                _, h, _ = bags(texts[a:b])
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                df += np.bincount(at[known[at] == h], minlength=len(known))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, df[at]))], names=["slot", "n"])

    idf = np.ones(len(words))
    if len(words):
        counted = rows.select("body").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(words) + 1, np.int64)
        df[counted.column("slot").to_numpy() + 1] = counted.column("n").to_numpy()
        idf = np.log((df[0] + 1) / (df[1:] + 1)) + 1
    return Space(words, idf.astype(np.float32), keys, label, sizes, slot, count)


def rate(docs: DataFrame, examples: Examples, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: score and evidence (ids of the nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(examples)

    @F.pandas_udf("score double, evidence array<long>")
    def score(texts: pd.Series) -> pd.DataFrame:
        x = sent.value
        got = x.judge([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"score": [s for s, _ in got], "evidence": [e for _, e in got]})

    return docs.withColumn(out, score(docs[text]))


def learnable(key: str = "doc_id") -> Column:
    return id_crc(key) % 5 != 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from ids whose crc32 is not 0 modulo 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learnable())
    rows = rate(docs, examples)
    return rows.select("doc_id", (~learnable()).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.evidence")
