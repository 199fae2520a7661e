"""Benchmark decontamination by the q-gram lemma, overlapping diagonal bands and banded alignment.

If an item of m characters occurs in a text with at most k edits, item and occurrence share at least
m - q + 1 - k*q character q-grams, all within k diagonals (text position minus item position) of
each other.  Shared q-grams are counted in bands of 2k+1 diagonals that overlap by k, so one band
holds them all.  Bands that meet the bound become regions, and an alignment within the band (the
whole item against a part of the text) decides, with edits counted exactly.  A first pass drops
stretches of text that hold too few q-grams of any item; it is a weaker form of the same bound, so
it loses nothing.

Runs and rulers repeat q-grams so often that hits times postings would grow with the square of their
length.  Where a stretch of text has more than ``PAIRS`` of them, its most repeated q-grams are left out
of the count and every item's bound falls by the number of its positions that hold one, which keeps
the lemma.  Items that consist of such q-grams alone have no bound left: their hits on each diagonal
are counted exactly by correlating the positions of each q-gram in text and item.  Texts are searched
in stretches of ``STRETCH`` characters that overlap by the longest occurrence.

Characters are lower-cased one to one and every white space is a space, so positions are code points
of the original text.  Items shorter than ``q`` characters match exactly only.  The items are sent to
the executors in blocks of about ``BLOCK_CHARS`` characters, one pass over the texts for each block,
so what is broadcast stays bounded however large the benchmark is.

Defined results: null and empty texts or items have no matches; repeated rows and ids each give their
own rows; texts of any length are searched whole in bounded memory; of overlapping occurrences of one item
the one with the fewest edits stays, then the first; an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import characters, table

Q = 10
BUDGET = 0.05  # edits per character of the item
BLOCK_CHARS = 4_000_000
BITS = 22
PAIRS = 1 << 20  # of text and item positions with one q-gram that are listed at once
STRETCH = 1 << 19  # characters of a text searched at once
SCHEMA = "row_key long, item_id long, start long, `end` long, edits int, item_chars int"


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of every q-gram."""
    h = np.zeros(max(0, len(c) - q + 1), np.uint32)
    for j in range(q):
        h *= np.uint32(0x01000193)
        h ^= c[j : j + len(h)]
    h *= np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(16))


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, budget: float = BUDGET):
        self.q, self.ids, self.codes = q, [i for i, _ in items], [characters(t) for _, t in items]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        # the largest k within the budget that leaves the lemma a bound of one q-gram at least
        self.k = np.maximum(0, np.minimum((self.m * budget).astype(np.int64), (self.m - q) // q))
        self.bound = np.maximum(1, self.m - q + 1 - self.k * q)
        parts = [grams(c, q) for c in self.codes]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p)) for p in parts] or [np.zeros(0, np.int64)])
        h = np.concatenate(parts or [np.zeros(0, np.uint32)])
        order = np.argsort(h, kind="stable")
        self.gram, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.owner, self.at = owner[order], at[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.gram >> np.uint32(32 - BITS)] = True
        self.short = [(n, c) for n, c in enumerate(self.codes) if 0 < len(c) < q]
        # the weaker bound: a region of at most m+k characters, cut into stretches of `span`, has
        # one stretch with at least its share of the q-grams
        long = self.m >= q
        self.reach = int((self.m + self.k)[long].max()) if long.any() else 0
        self.span = int(self.m[long].min()) if long.any() else 0
        share = -(-self.bound[long] // -(-(self.m + self.k)[long] // max(1, self.span))) if long.any() else np.array([1])
        self.least = int(max(1, share.min()))

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) of every occurrence; the best one of overlapping ones."""
        c = characters(text)
        out = [(n, s, s + len(x), 0) for n, x in self.short for s in _exact(c, x)]
        if self.reach and len(c) >= self.q:
            found = []
            for a in range(0, max(1, len(c) - self.reach), STRETCH):
                found += [(n, a + s, a + e, d) for n, s, e, d in self._long(c[a : a + STRETCH + self.reach])]
            out += _best(found)
        return out

    def _long(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        h = grams(c, self.q)
        pos = np.flatnonzero(self.bitmap[h >> np.uint32(32 - BITS)])
        if len(pos) < self.least:
            return []
        slot = np.searchsorted(self.gram, h[pos])
        good = self.gram[np.minimum(slot, len(self.gram) - 1)] == h[pos]
        pos, slot = pos[good], slot[good]
        if len(pos) < self.least:
            return []
        # hits within `span` of one another, `least` of them
        dense = pos[self.least - 1 :] - pos[: len(pos) - self.least + 1] < self.span
        if not dense.any():
            return []
        near = np.zeros(len(c) + 1, np.int32)
        np.add.at(near, np.maximum(0, pos[: len(dense)][dense] - self.reach), 1)
        np.add.at(near, np.minimum(len(c), pos[self.least - 1 :][dense] + self.reach), -1)
        stays = np.cumsum(near)[pos] > 0
        pos, slot = pos[stays], slot[stays]
        found = []
        bound, whole = self.bound, []
        n = self.first[slot + 1] - self.first[slot]
        if n.sum() > PAIRS:
            left, bound, whole = self._light(slot)
            pos, slot = pos[left], slot[left]
            n = self.first[slot + 1] - self.first[slot]
            for i in whole:
                found += self._dense(c, h, int(i))
        entry = np.repeat(self.first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[entry]
        diagonal = np.repeat(pos, n) - self.at[entry]
        # bands of 2k+1 diagonals every k+1: any k+1 neighbouring diagonals lie in one of them
        step = self.k[item] + 1
        shift = int(self.m.max()) + 1
        band = (diagonal + shift) // step
        wide = len(c) + shift + 2
        keys = np.concatenate([item * wide + band, item * wide + np.maximum(band - 1, 0)])
        key, count = np.unique(keys, return_counts=True)
        for x in key[count >= np.maximum(1, bound[key // wide])]:
            i, b = int(x // wide), int(x % wide)
            if bound[i] > 0:
                found += self._band(c, i, b, shift)
        return found

    def _band(self, c: np.ndarray, i: int, b: int, shift: int) -> list[tuple[int, int, int, int]]:
        low = b * int(self.k[i] + 1) - shift  # band b: diagonals low .. low + 2k + 1
        return _verify(c, self.codes[i], low, low + 2 * int(self.k[i]) + 1, int(self.k[i]), i)

    def _light(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which hits stay, the items' bounds among them, the items without a bound left)."""
        times = np.bincount(slot, minlength=len(self.gram)) * np.diff(self.first)
        order = np.argsort(times, kind="stable")
        stays = np.zeros(len(self.gram), bool)
        stays[order[: np.searchsorted(np.cumsum(times[order]), PAIRS, "right")]] = True
        heavy = ~np.repeat(stays, np.diff(self.first))
        bound = self.bound - np.bincount(self.owner[heavy], minlength=len(self.m))
        return stays[slot], bound, np.flatnonzero((bound <= 0) & (self.m >= self.q))

    def _dense(self, c: np.ndarray, h: np.ndarray, i: int) -> list[tuple[int, int, int, int]]:
        """Occurrences of an item of repeated q-grams: hits on every diagonal by correlation."""
        own = grams(self.codes[i], self.q)
        different = np.unique(own)
        if not np.isin(different, h).any():
            return []
        size = 1 << int(len(h) + len(own)).bit_length()
        total = np.zeros(size)
        for g in different:
            here = np.flatnonzero(h == g)
            if len(here):
                text, item = np.zeros(size), np.zeros(size)
                text[here] = 1
                item[(-np.flatnonzero(own == g)) % size] = 1
                total += np.rint(np.fft.irfft(np.fft.rfft(text) * np.fft.rfft(item), size))
        # total[d] is the number of hits on diagonal d; diagonals below 0 are at the end
        shift = int(self.m.max()) + 1
        step = int(self.k[i]) + 1
        low = np.arange(-len(own), len(h))
        count = np.bincount((low + shift) // step, total[low % size])
        count = count + np.append(count[1:], 0)
        return [x for b in np.flatnonzero(np.rint(count) >= self.bound[i]).tolist() for x in self._band(c, i, b, shift)]


def _exact(c: np.ndarray, x: np.ndarray) -> list[int]:
    if len(c) < len(x):
        return []
    ok = np.ones(len(c) - len(x) + 1, bool)
    for j, v in enumerate(x):
        ok &= c[j : j + len(ok)] == v
    return np.flatnonzero(ok).tolist()


def _verify(c, item, low, high, k, number):
    """Align the whole item with a part of the text along diagonals low..high; at most k edits."""
    m = len(item)
    for d in range(max(0, low), min(high, len(c) - m) + 1):  # no edits: the text on one diagonal
        if c[d] == item[0] and np.array_equal(c[d : d + m], item):
            return [(number, d, d + m, 0)]
    # cell (row r, offset j) stands for text position r + low + j
    width, far = high - low + 1, 1 << 20
    text = np.full(m + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(c), low + m + width)
    if b <= a:
        return []
    text[a - low : b - low] = c[a:b]
    place = np.arange(width) + low
    cost = np.where((place >= 0) & (place <= len(c)), 0, far)  # the item may begin anywhere
    begin = place.copy()
    ramp = np.arange(width)
    for r in range(m):
        swap = cost + (text[r : r + width] != item[r])
        drop = np.append(cost[1:], far) + 1  # the item's character is missing in the text
        take = drop < swap
        new, origin = np.where(take, drop, swap), np.where(take, np.append(begin[1:], 0), begin)
        # text characters that the item lacks: best of new[j'] + (j - j') over j' <= j
        slope = new - ramp
        best = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == best, ramp, 0))
        cost, begin = best + ramp, origin[source]
        if cost.min() > k:
            return []
    end = place + m
    cost = np.where((end >= 0) & (end <= len(c)), cost, far)
    j = int(cost.argmin())
    return [(number, int(begin[j]), int(end[j]), int(cost[j]))] if cost[j] <= k else []


def _best(found):
    """Of overlapping occurrences of one item, the one with the fewest edits (then the first)."""
    out = []
    starts: dict[int, list[int]] = {}  # of an item's chosen occurrences, which do not overlap
    ends: dict[int, list[int]] = {}
    for x in sorted(set(found), key=lambda x: (x[0], x[3], x[1], x[2])):
        s, e = starts.setdefault(x[0], []), ends.setdefault(x[0], [])
        i = bisect_left(s, x[2])  # those before i start before x ends
        if i and e[i - 1] > x[1]:
            continue
        s.insert(i, x[1])
        e.insert(i, x[2])
        out.append(x)
    return sorted(out, key=lambda x: (x[1], x[0]))


def _blocks(items: DataFrame, block_chars: int):
    """Lists of (item_id, text) of about ``block_chars`` characters each, one at a time."""
    rows = items.select("item_id", "text").where(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.where(part == b).orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", q: int = Q, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row_key, item_id, start, end, edits, item_chars) of every occurrence within the budget."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("body"))
    found = []
    for block in _blocks(items, block_chars):
        index = spark.sparkContext.broadcast(Index(block, q, budget))

        def run(batches, index=index):
            ix = index.value
            for batch in batches:
                keys, out = batch.column(0), []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if t:
                        out += [(keys[i].as_py(), ix.ids[n], s, e, d, int(ix.m[n])) for n, s, e, d in ix.search(t)]
                names = ["row_key", "item_id", "start", "end", "edits", "item_chars"]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names=names)

        found.append(rows.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def _leaked(index):
    @F.pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: isinstance(t, str) and bool(index.value.search(t))).astype(bool)

    return leaked


def clean(docs: DataFrame, items: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of an item; same columns."""
    for block in _blocks(items, block_chars):
        docs = docs.where(~_leaked(docs.sparkSession.sparkContext.broadcast(Index(block)))(docs[text]))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document: one row each."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("row_key", "doc_id")
