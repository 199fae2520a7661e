"""Packing by lexical retrieval: neighbours of a seed document fill its window.

Documents are token ids with an end id.  They are ordered by a content key (copies and similar
texts come close) and cut into shards of about ``SHARD`` tokens; each shard is a BM25 inverted index
over token ids, with document frequencies and lengths from the whole corpus.  A window of ``WINDOW``
tokens starts with the rest of the document that the last window cut, or with the next unused one;
then the unused documents that BM25 ranks highest for the seed follow until the window is full, and
the last of them is cut.  So only the last window of a task can stay short; it is cut into sequences
whose lengths are powers of two, and nothing is padded.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed one by
one; ties go to the earlier document in content order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import keep, partitions, table

WINDOW = 2048
SHARD = 1_000_000
END = 1
TERMS = 16  # of the seed's terms, the heaviest ones that are looked up
K1, B = 1.2, 0.75
LONG = 100_000  # characters; longer texts are encoded by the tokenizer file itself
# White space as the tokenizer's pattern takes it; two or more in a row
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = f"[{WHITE}]{{2}}"
BEFORE_LAST = re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
AHEAD = r"|\s+(?!\S)"
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Tokens:
    """What the driver reads of the tokenizer file, sent to the tasks: they need not load it."""

    tokenizer: str
    ranks: str
    special: tuple[str, ...]
    size: int

    @classmethod
    def of(cls, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Tokens:
        slow = _tokenizer(tokenizer)
        return cls(tokenizer, ranks, tuple(t.content for t in slow.get_added_tokens_decoder().values()), slow.get_vocab_size())

    @property
    def kind(self):
        return np.uint16 if self.size <= 1 << 16 else np.uint32


@cache
def _tokenizer(name: str):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.path(name))


class Encoder:
    """Token ids of whole texts, as the tokenizer file gives them.

    The same vocabulary as ranks gives the same ids faster.  The pattern's look-ahead, which makes it slow,
    only leaves the last character of a run of white space to what follows: texts are cut before that
    character, and the pieces are the same without it.  Texts with a special token's string go through the
    tokenizer file itself, and so do texts of more than ``LONG`` characters: the faster library fails on
    runs of white space that are some hundred thousand characters long.
    """

    def __init__(self, about: Tokens):
        import public_tokenizers as files
        import tiktoken

        self.about, self.code = about, "H" if about.kind is np.uint16 else "I"
        with open(files.path(about.ranks), "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        assert AHEAD in files.PATTERN
        self.fast = tiktoken.Encoding("own", pat_str=files.PATTERN.replace(AHEAD, ""), mergeable_ranks=pairs, special_tokens={})

    def __call__(self, text: str, runs: bool = True) -> bytes:
        """The ids of ``text`` as bytes of the ids' kind; without ``runs`` no two white-space characters meet in it."""
        if len(text) > LONG or any(s in text for s in self.about.special):
            ids = _tokenizer(self.about.tokenizer).encode(text, add_special_tokens=False).ids
        elif runs:
            ids = [i for part in BEFORE_LAST.split(text) for i in self.fast.encode_ordinary(part)]
        else:
            ids = self.fast.encode_ordinary(text)
        return array(self.code, ids).tobytes()


@cache
def encoder(about: Tokens) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(about)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, place, df, n_docs): a row for each document (ids with the end id, and the content
    key that it is ordered by), and one for each task with its document frequencies by token."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    about = Tokens.of(tokenizer, ranks)

    def run(batches):
        enc, kind = encoder(about), about.kind
        end = np.array([END], kind).tobytes()
        df = np.zeros(about.size + 1, np.int64)
        last = np.zeros(about.size + 1, np.int64)  # where a token stands last in the document at hand
        total = n = 0
        names = ["doc_id", "ids", "place", "df", "n_docs", "n_tokens"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in batches:
            ids, place = [], []
            known: dict[str, bytes] = {}  # copies in a batch are encoded once
            runs = pc.match_substring_regex(batch.column("body"), RUN).to_pylist()
            for t, meets in zip(batch.column("body").to_pylist(), runs, strict=True):
                if t not in known:
                    known[t] = (enc(t, meets) if t else b"") + end
                ids.append(known[t])
                x = np.frombuffer(ids[-1], kind)
                at = np.arange(len(x))
                last[x] = at
                df[x[last[x] == at]] += 1  # each token once
                total += len(x)
                n += 1
                y = x.astype(np.uint32)
                pair = (y[:-1] * np.uint32(0x9E3779B1) ^ y[1:]) * np.uint32(0x85EBCA6B)
                place.append(int(pair.min()) if len(pair) else 0)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([batch.column("doc_id").to_pylist(), ids, place, none, none, none], kinds, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip([None, None, None, df, n, total], kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, ids binary, place long, df array<long>, n_docs long, n_tokens long")


class Shard:
    """The BM25 index of some documents, and which of them are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(ids)
        term, count = zip(*(np.unique(x, return_counts=True) for x in ids), strict=True)
        sizes = np.array([len(t) for t in term])
        doc = np.repeat(np.arange(self.n), sizes)
        flat, tf = np.concatenate(term), np.concatenate(count).astype(np.float32)
        length = np.array([len(x) for x in ids], np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(flat, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(idf)))])
        # the terms that a document would be searched with: the heaviest ones (the sort is stable)
        self.term, self.own, self.begin = flat, weight, np.concatenate([[0], np.cumsum(sizes)])
        self.unused = np.ones(self.n, bool)

    def neighbours(self, seed: int):
        """Unused documents with a common term, best first."""
        a, b = self.begin[seed], self.begin[seed + 1]
        own = self.own[a:b]
        query = self.term[a:b][np.argpartition(-own, TERMS)[:TERMS]] if b - a > TERMS else self.term[a:b]
        parts = [slice(self.first[t], self.first[t + 1]) for t in np.sort(query).tolist()]
        score = np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), self.n)
        score[~self.unused] = 0
        while True:
            best = int(score.argmax())
            if score[best] <= 0:
                return
            score[best] = 0
            yield best


class Packer:
    """Windows of one task; the last one stays open from shard to shard."""

    def __init__(self, part: int, window: int):
        self.window, self.next, self.room, self.open, self.rows = window, part << 32, window, [], []

    def put(self, doc: int, start: int, size: int) -> int:
        """Place as much of the piece as fits; the number of tokens placed."""
        n = min(size, self.room)
        self.open.append((doc, start, n))
        self.room -= n
        if not self.room:
            self.close(self.open)
            self.open, self.room = [], self.window
        return n

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, n in pieces:
            self.rows.append((doc, start, n, self.next, at))
            at += n
        self.next += 1

    def finish(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        left = self.open
        while left:
            total = sum(n for *_, n in left)
            size, now, later = 1 << (total.bit_length() - 1), [], []
            for doc, start, n in left:
                take = min(n, size)
                if take:
                    now.append((doc, start, take))
                    size -= take
                if n > take:
                    later.append((doc, start + take, n - take))
            self.close(now)
            left = later
        self.open, self.room = [], self.window

    def fill(self, shard: Shard, sizes: list[int], base: int) -> None:
        """Place every document of a shard; document i is called base + i."""
        after = 0
        seed, near = None, iter(())
        while True:
            fresh = len(self.open) == 0 or seed is None
            i = None if fresh else next(near, None)
            if i is None:
                while after < shard.n and not shard.unused[after]:
                    after += 1
                if after == shard.n:
                    return
                i = after
                seed, near = i, shard.neighbours(i)
            shard.unused[i] = False
            start, left = 0, sizes[i]
            while left:
                n = self.put(base + i, start, left)
                start, left = start + n, left - n
                if left:  # cut: the rest is the seed of the next window
                    seed, near = i, shard.neighbours(i)
            if not self.open:
                seed = None


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    every = keep(tokens(docs, key, text, tokenizer, ranks), "tokens")
    stats = every.where("df IS NOT NULL")
    size = stats.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    n_docs, mean = size[0] or 0, max(1.0, (size[1] or 0) / max(1, size[0] or 0))
    # one row for each token of the vocabulary
    counted = stats.select(F.posexplode("df").alias("token", "n")).where("n > 0").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 + max([r["token"] for r in counted], default=0))
    for r in counted:
        df[r["token"]] = r["n"]
    idf = spark.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32))
    rows = every.where("ids IS NOT NULL").select("place", "doc_id", "ids")
    # range partitions over (place, id): even, and a place that a third of all rows has is split
    rows = rows.repartitionByRange(partitions(spark), "place", "doc_id").sortWithinPartitions("place", "doc_id", "ids")

    kind = Tokens.of(tokenizer, ranks).kind

    def run(batches):
        packer, names, ids, total, base = Packer(TaskContext.get().partitionId(), window), [], [], 0, 0
        held: dict[int, tuple] = {}  # documents of this shard, and those with pieces in the open window

        def out():
            pieces, packer.rows = packer.rows, []
            columns = [[], [], [], [], [], [], []]
            for doc, start, n, seq, at in pieces:
                name, x = held[doc]
                for c, v in zip(columns, (name, start, n, x[start : start + n].astype("<u4").tobytes(), len(x), seq, at), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def shard():
            nonlocal names, ids, total, base
            for i, x in enumerate(ids):
                held[base + i] = (names[i], x)
            packer.fill(Shard(ids, idf.value, mean), [len(x) for x in ids], base)
            base += len(ids)
            names, ids, total = [], [], 0
            batch = out()
            still = {doc for doc, *_ in packer.open}
            for doc in [d for d in held if d not in still]:
                del held[doc]
            return batch

        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(name)
                ids.append(np.frombuffer(x, kind))
                total += len(ids[-1])
                if total >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()
        packer.finish()
        yield out()

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    rows = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
