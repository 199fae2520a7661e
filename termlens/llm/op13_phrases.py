"""Phrase collocations through weighted acyclic automata.

Every shard (about 8 MB of one language's text) counts its n-grams, sorts them and builds an acyclic
automaton over words whose arcs carry counts: finished states go through a register, so states with
equal arcs (word, count, next state) are one.  N-grams are cut at bounds drawn from a sample (they
only balance the work); the automata of one language and prefix range meet in one group, whose union
sums the counts.  The phrase scores need the counts of a phrase's parts: first parts are states on the
phrase's own path, the others are asked of the range that holds them, which walks its automaton and
replies.  No word, phrase or language is ever joined by value, so a hot one makes no large group.

Order of n-grams: word by word, by UTF-8 bytes.  A range holds about ``RANGE`` bytes of text's
n-grams; there are at most ``MOST`` ranges, so bounds are sent to every task with a known limit
(beyond 4 TB of text ranges grow in proportion).

Defined results: a null text is empty and has no words, a null language is ``und``; texts of any
length are counted in pieces that overlap by the words of a phrase; equal scores go by count, then by
the phrase's bytes; repeated rows count again; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlens.llm.common import keep, parts, sample_share, table

WORDS = 3  # of the longest phrase
LEAST = 10  # occurrences of a candidate
SHARE = 50  # per cent of a candidate's occurrences inside a longer candidate that drop it
TOP = 2000  # phrases of a language
SCALE = 1_000_000
SHARD = 8 << 20  # bytes of text counted at once
RANGE = 4 << 20  # bytes of text for each prefix range
MOST = 1 << 20  # ranges
PER_RANGE, PER_TEXT, SAMPLED = 64, 16, 1 << 21  # sampled n-grams: of a range, of a text, in all

_FOLD = bytes(ord(",") if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = re.compile(rb"[ ,]")
_BREAK = b","

Gram = tuple[bytes, ...]


def tokens_of(folded: bytes) -> list[bytes]:
    """Words and breaks (a comma) of folded text."""
    return folded.replace(b",", b" , ").split()


def pieces(text: bytes, words: int, limit: int) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, how many of them start n-grams here) of pieces of a text of about ``limit`` bytes; the
    rest are the next words, up to a break, that n-grams starting here may reach."""
    folded, at = text.translate(_FOLD), 0
    ahead = re.compile(rb"(?: +[^ ,]+){0,%d}" % (words - 1))
    while at < len(folded):
        end = _END.search(folded, min(len(folded), at + limit))
        end = end.start() if end else len(folded)
        here = tokens_of(folded[at:end])
        yield here + tokens_of(ahead.match(folded, end).group()), len(here)
        at = end


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, sorted; the sum of each one's weights; each row's place among them)."""
    if not len(keys):
        return keys, weights, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return k[first], np.add.reduceat(weights[order], first), place


class Grams:
    """Sorted n-grams with counts, level by level: level k has a row (parent, label, count) for every
    (k+1)-gram, ordered by parent (a row of the level above) and label (a place in ``labels``).  A row
    with count 0 is only the beginning of longer ones."""

    def __init__(self, labels: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.labels, self.levels = labels, levels

    @classmethod
    def counted(cls, tokens: list[bytes], starts: np.ndarray, words: int) -> Grams:
        """All n-grams of up to ``words`` words that begin at ``starts`` and cross no break."""
        labels = sorted({*tokens} - {_BREAK})
        number = {w: i for i, w in enumerate(labels)} | {_BREAK: -1}
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        at, levels = starts[ids[starts] >= 0], []
        parent = np.zeros(len(at), np.int64)
        for k in range(words):
            if k:
                inside = at + k < len(ids)
                at, parent = at[inside], parent[inside]
                inside = ids[at + k] >= 0
                at, parent = at[inside], parent[inside]
            keys, counts, place = _grouped(parent * len(labels) + ids[at + k], np.ones(len(at), np.int64))
            levels.append((*np.divmod(keys, max(1, len(labels))), counts))
            parent = place
        return cls(labels, levels)

    @classmethod
    def union(cls, many: list[Grams], words: int) -> Grams:
        """The n-grams of all with their counts summed."""
        labels = sorted(set().union(*(g.labels for g in many)))
        number = {w: i for i, w in enumerate(labels)}
        maps = [np.fromiter((number[w] for w in g.labels), np.int64, len(g.labels)) for g in many]
        places, levels = [np.zeros(1, np.int64)] * len(many), []
        for k in range(words):
            rows = [(places[i][g.levels[k][0]], maps[i][g.levels[k][1]], g.levels[k][2]) for i, g in enumerate(many)]
            keys, counts, place = _grouped(np.concatenate([p * len(labels) + w for p, w, _ in rows]), np.concatenate([c for _, _, c in rows]))
            levels.append((*np.divmod(keys, max(1, len(labels))), counts))
            places = np.split(place, np.cumsum([len(p) for p, _, _ in rows])[:-1])
        return cls(labels, levels)

    def before(self, bound: Gram) -> list[int]:
        """At each level, how many n-grams come before ``bound``."""
        out, on_path, low, high, at = [], True, 0, len(self.levels[0][0]), 0
        for k, (parent, label, _) in enumerate(self.levels):
            if not on_path:
                at = int(np.searchsorted(parent, at))
                out.append(at)
                continue
            number = bisect_left(self.labels, bound[k])
            at = low + int(np.searchsorted(label[low:high], number))
            on_path = k + 1 < len(bound) and at < high and label[at] == number and self.labels[number] == bound[k]
            out.append(at + on_path)  # a beginning of the bound comes before it
            if on_path and k + 1 < len(self.levels):
                low, high = np.searchsorted(self.levels[k + 1][0], [at, at + 1])
        return out

    def cut(self, bounds: list[Gram]) -> Iterator[tuple[int, Grams]]:
        """(number of the range, its n-grams) for the ranges between the bounds that hold any."""
        edges = [[0] * len(self.levels), *map(self.before, bounds), [len(x[0]) for x in self.levels]]
        for i, (start, end) in enumerate(zip(edges, edges[1:])):
            if any(a < b for a, b in zip(start, end)):
                yield i, self.part(start, end)

    def part(self, start: list[int], end: list[int]) -> Grams:
        """The rows start[k]:end[k] of each level k, and what they begin with (counted 0)."""
        spans, need = [], None
        for k in reversed(range(len(self.levels))):
            a, b = start[k], end[k]
            if need:
                a, b = (min(a, need[0]), max(b, need[1])) if a < b else need
            spans.insert(0, (a, b))
            parent = self.levels[k][0]
            need = (int(parent[a]), int(parent[b - 1]) + 1) if a < b else None
        levels, base = [], 0
        for k, (a, b) in enumerate(spans):
            parent, label, count = (x[a:b] for x in self.levels[k])
            own = np.arange(a, b)
            levels.append((parent - base, label, np.where((own >= start[k]) & (own < end[k]), count, 0)))
            base = a
        used = np.unique(np.concatenate([x[1] for x in levels]))
        return Grams([self.labels[i] for i in used], [(p, np.searchsorted(used, w), c) for p, w, c in levels])

    def paths(self, level: int, rows: np.ndarray) -> np.ndarray:
        """The labels of n-grams of ``level``, one row each."""
        out = np.empty((len(rows), level + 1), np.int64)
        for k in reversed(range(level + 1)):
            parent, label, _ = self.levels[k]
            out[:, k] = label[rows]
            rows = parent[rows]
        return out


class Automaton:
    """A minimal acyclic automaton: the arcs of state s are first[s]:first[s+1], sorted by label, each
    with a count and the next state; state 0 has no arcs.  The root comes last."""

    def __init__(self, labels: list[bytes], arcs: np.ndarray, first: np.ndarray, words: int):
        self.labels, self.arcs, self.first, self.words = labels, arcs, first, words

    @classmethod
    def built(cls, grams: Grams) -> Automaton:
        """From sorted n-grams: the states of each level are finished once those they lead to are, and
        each finished state is looked up in the register by its arcs."""
        register: dict[bytes, int] = {b"": 0}
        made, sizes = [], [0]
        state = np.zeros(len(grams.levels[-1][0]), np.int64)  # of the rows of the level below
        for k in reversed(range(len(grams.levels))):
            parent, label, count = grams.levels[k]
            arcs = np.stack([label, count, state], 1)
            above = len(grams.levels[k - 1][0]) if k else 1
            edge = np.searchsorted(parent, np.arange(above + 1))
            size = np.diff(edge)
            state = np.zeros(above, np.int64)
            single = np.flatnonzero(size == 1)
            # states of one arc are the most: equal ones are found by sorting, and registered once
            rows = np.ascontiguousarray(arcs[edge[single]]).view("V24").ravel()
            different, place = np.unique(rows, return_inverse=True)
            numbers = np.empty(len(different), np.int64)
            for i, raw in enumerate(x.tobytes() for x in different):
                numbers[i] = _state(register, raw, made, sizes)
            state[single] = numbers[place] if len(single) else 0
            for i in np.flatnonzero(size > 1).tolist():
                state[i] = _state(register, arcs[edge[i] : edge[i + 1]].tobytes(), made, sizes)
            if not k and not size[0]:
                sizes.append(0)
        if sizes[-1] and state[0] != len(sizes) - 1:  # the root is a state of its own
            made.append(made[int(state[0]) - 1])
            sizes.append(sizes[int(state[0])])
        arcs = np.frombuffer(b"".join(made), np.int64).reshape(-1, 3)
        return cls(grams.labels, arcs, np.concatenate([[0], np.cumsum(sizes)]), len(grams.levels))

    def grams(self) -> Grams:
        """All n-grams on the paths from the root."""
        state, levels = np.array([len(self.first) - 2]), []
        for _ in range(self.words):
            size = self.first[state + 1] - self.first[state]
            parent = np.repeat(np.arange(len(state)), size)
            place = np.repeat(self.first[state] - np.cumsum(size) + size, size) + np.arange(len(parent))
            label, count, state = self.arcs[place].T
            levels.append((parent, label, count))
        return Grams(self.labels, levels)

    def walk(self, grams: list[Gram]) -> np.ndarray:
        """The counts of n-grams (0: not there), all walked at once."""
        number = {w: i for i, w in enumerate(self.labels)}
        width = len(self.labels) + 1
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * width + self.arcs[:, 0]
        state = np.full(len(grams), len(self.first) - 2)
        count = np.zeros(len(grams), np.int64)
        for k in range(max(map(len, grams), default=0)):
            on = np.flatnonzero([len(g) > k for g in grams])
            label = np.fromiter((number.get(grams[i][k], width - 1) for i in on), np.int64, len(on))
            key = state[on] * width + label
            place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = (keys[place] == key) if len(keys) else np.zeros(len(on), bool)
            count[on] = np.where(hit, self.arcs[place, 1], 0) if len(keys) else 0
            state[on] = np.where(hit, self.arcs[place, 2], 0) if len(keys) else 0
        return count

    def packed(self) -> bytes:
        """The arrays, each as the narrowest unsigned integers that hold it."""
        out = [b"\t".join(self.labels), np.diff(self.first), *self.arcs.T]
        out = [x if isinstance(x, bytes) else _narrow(x) for x in out]
        head = np.array([self.words, len(self.labels), *map(len, out)], np.int64).tobytes()
        return head + pa.compress(b"".join(out), "zstd", asbytes=True)

    @classmethod
    def unpacked(cls, raw: bytes) -> Automaton:
        words, n, *sizes = np.frombuffer(raw[:56], np.int64).tolist()
        body, at, out = pa.decompress(raw[56:], sum(sizes), "zstd", asbytes=True), 0, []
        for size in sizes:
            out.append(body[at : at + size])
            at += size
        arrays = [_wide(x) for x in out[1:]]
        return cls(out[0].split(b"\t") if n else [], np.stack(arrays[1:], 1), np.concatenate([[0], np.cumsum(arrays[0])]), words)


def _state(register: dict[bytes, int], raw: bytes, made: list[bytes], sizes: list[int]) -> int:
    number = register.get(raw)
    if number is None:
        number = register[raw] = len(sizes)
        made.append(raw)
        sizes.append(len(raw) // 24)
    return number


def _narrow(x: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], f"u{raw[0]}").astype(np.int64)


class Bounds:
    """The range numbers of (language, n-gram): how many bounds are not above it."""

    def __init__(self, bounds: list[tuple[str, Gram]]):
        self.languages: dict[str, tuple[int, list[Gram]]] = {}
        self.all = sorted(set(bounds))
        for i, (lang, gram) in enumerate(self.all):
            self.languages.setdefault(lang, (i, []))[1].append(gram)

    def of(self, lang: str) -> tuple[int, list[Gram]]:
        """(number of the language's first range, its bounds)."""
        return self.languages[lang] if lang in self.languages else (bisect_left(self.all, (lang, ())), [])

    def range(self, lang: str, gram: Gram) -> int:
        first, grams = self.of(lang)
        return first + bisect_right(grams, gram)


def _language(lang: str) -> F.Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")


def bounds_of(rows: DataFrame, words: int) -> Bounds:
    """Bounds of about ``RANGE`` bytes of text, from n-grams of a fixed share of the texts."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = int(min(MOST, (size["bytes"] or 0) // RANGE + 1))
    wanted = min(SAMPLED, max(8192, PER_RANGE * ranges))

    def sampled(batches):
        for batch in batches:
            for here, texts in parts(batch, "text"):
                langs, grams = [], []
                for lang, text in zip(here.column("lang").to_pylist(), texts):
                    n = max(1, len(text) // PER_TEXT)
                    for a in range(0, len(text), n):
                        start = _END.search(text, a)
                        # the first break or space after the place, and the words after it
                        for tokens, _ in pieces(text[start.end() : start.end() + 256] if start else text[a : a + 256], words, 256):
                            run = tokens[: tokens.index(_BREAK)] if _BREAK in tokens else tokens
                            langs += [lang] * min(1, len(run))
                            grams += [b"\t".join(run[:words])] * min(1, len(run))
                            break
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.binary())], ["lang", "gram"])

    if ranges == 1:
        return Bounds([])
    share = wanted / PER_TEXT / max(1, size["n"])
    found = rows.where(sample_share(F.xxhash64("text"), share)).mapInArrow(sampled, "lang string, gram binary").distinct()
    grams = sorted((r["lang"], tuple(bytes(r["gram"]).split(b"\t"))) for r in found.toLocalIterator())
    return Bounds([grams[i * len(grams) // ranges] for i in range(1, ranges)] if grams else [])


def shards(rows: DataFrame, bounds, words: int, limit: int = SHARD) -> DataFrame:
    """(range, lang, automaton) of every shard of (lang, text), cut at the bounds."""

    def build(lang: str, tokens: list[bytes], starts: list[tuple[int, int]], found: dict):
        where = np.concatenate([np.arange(a, b) for a, b in starts]) if starts else np.zeros(0, np.int64)
        first, grams = bounds.value.of(lang)
        for i, part in Grams.counted(tokens, where, words).cut(grams):
            found["range"].append(first + i)
            found["lang"].append(lang)
            found["automaton"].append(Automaton.built(part).packed())

    def run(batches):
        schema = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("automaton", pa.binary())])
        open_: dict[str, list] = {}
        found = {"range": [], "lang": [], "automaton": []}

        def flush(lang):
            tokens, starts, _ = open_.pop(lang)
            build(lang, tokens, starts, found)
            yield pa.RecordBatch.from_pydict(found, schema)
            for x in found.values():
                x.clear()

        for batch in batches:
            for here, texts in parts(batch, "text"):
                for lang, text in zip(here.column("lang").to_pylist(), texts):
                    for tokens, n in pieces(text, words, limit // 4):
                        own = open_.setdefault(lang, [[], [], 0])
                        own[1].append((len(own[0]), len(own[0]) + n))
                        own[0] += tokens
                        own[0].append(_BREAK)
                        own[2] += sum(map(len, tokens)) + len(tokens)
                        if own[2] >= limit:
                            yield from flush(lang)
                while sum(x[2] for x in open_.values()) >= 2 * limit:
                    yield from flush(max(open_, key=lambda x: open_[x][2]))
        for lang in sorted(open_):
            yield from flush(lang)

    return rows.mapInArrow(run, "range long, lang string, automaton binary")


def united(shards: DataFrame, words: int) -> DataFrame:
    """One automaton for each range and language: the union of the shards', counts summed, and ``n``,
    the word occurrences that begin in the range."""

    def run(key, group):
        whole = Grams.union([Automaton.unpacked(x).grams() for x in group.column("automaton").to_pylist()], words)
        return pa.table({"range": [key[0].as_py()], "lang": [key[1].as_py()], "n": [int(whole.levels[0][2].sum())], "automaton": pa.array([Automaton.built(whole).packed()], pa.binary())})

    return shards.groupBy("range", "lang").applyInArrow(run, "range long, lang string, n long, automaton binary")


def _candidates(grams: Grams, least: int) -> Iterator[tuple[Gram, int, list[int]]]:
    """(phrase, count, the counts of its first parts as far as this range has them)."""
    for k in range(1, len(grams.levels)):
        rows = np.flatnonzero(grams.levels[k][2] >= least)
        known, above = [], rows
        for j in reversed(range(k)):
            above = grams.levels[j + 1][0][above]
            known.insert(0, grams.levels[j][2][above])
        known = np.stack(known, 1).tolist() if len(rows) else []
        for path, count, first in zip(grams.paths(k, rows).tolist(), grams.levels[k][2][rows].tolist(), known):
            yield tuple(grams.labels[i] for i in path), count, first


def _asked(phrase: Gram, first: list[int]) -> list[Gram]:
    """The parts of a phrase whose counts other ranges may have."""
    return [p for k in range(1, len(phrase)) for p in ((phrase[k:],) if first[k - 1] else (phrase[:k], phrase[k:]))]


def scored(whole: DataFrame, bounds, least: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every candidate."""

    def ask(batches):
        for batch in batches:
            for source, lang, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "automaton"))):
                wanted = sorted({p for phrase, _, first in _candidates(Automaton.unpacked(raw).grams(), least) for p in _asked(phrase, first)})
                n = len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bounds.value.range(lang, p) for p in wanted], pa.int64()), pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.int64()), pa.array([b"\t".join(p) for p in wanted], pa.binary())],
                    ["range", "lang", "source", "part"],
                )

    def reply(key, asked, own):
        wanted = asked.column("part").to_pylist()
        grams = [tuple(p.split(b"\t")) for p in wanted]
        counts = Automaton.unpacked(own.column("automaton")[0].as_py()).walk(grams) if own.num_rows else np.zeros(len(grams), np.int64)
        return pa.table({"source": asked.column("source"), "lang": asked.column("lang"), "part": pa.array(wanted, pa.binary()), "count": pa.array(counts, pa.int64())})

    def score(key, replies, own):
        out = {c: [] for c in ("phrase", "words", "a", "l", "r", "score")}
        if own.num_rows:
            counts = dict(zip((tuple(p.split(b"\t")) for p in replies.column("part").to_pylist()), replies.column("count").to_pylist()))
            for phrase, a, first in _candidates(Automaton.unpacked(own.column("automaton")[0].as_py()).grams(), least):
                cuts = [(first[k - 1] or counts[phrase[:k]], counts[phrase[k:]]) for k in range(1, len(phrase))]
                for c, v in zip(out, (b" ".join(phrase).decode("utf-8", "replace"), len(phrase), a, *_lowest(a, cuts))):
                    out[c].append(v)
        n = len(out["a"])
        types = {"phrase": pa.string(), "words": pa.int32()}
        return pa.table({"lang": pa.array([key[1].as_py()] * n, pa.string()), **{c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()}})

    own = whole.select("range", "lang", "automaton")
    asked = own.mapInArrow(ask, "range long, lang string, source long, part binary")
    replies = asked.groupBy("range", "lang").cogroup(own.groupBy("range", "lang")).applyInArrow(reply, "source long, lang string, part binary, count long")
    return replies.groupBy("source", "lang").cogroup(own.groupBy("range", "lang")).applyInArrow(score, "lang string, phrase string, words int, a long, l long, r long, score long")


def _lowest(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(l, r, score) of the lowest-scoring cut, the first of equal ones; exact integers of any size."""
    score, i = min((SCALE * a * a // (x * y), i) for i, (x, y) in enumerate(cuts))
    return *cuts[i], score


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``words`` words with at least ``least`` occurrences."""
    spark = docs.sparkSession
    rows = docs.select(_language(lang), F.col(text).cast("string").alias("text")).where("text is not null")
    bounds = spark.sparkContext.broadcast(bounds_of(rows, words))
    whole = keep(united(shards(rows, bounds, words), words), "grams")
    found = keep(scored(whole, bounds, least), "phrases")

    # what longer candidates contain, with the most frequent of them
    word = F.split("phrase", " ")
    runs = [(s, n) for n in range(2, words) for s in range(1, words - n + 2)]
    inner = [F.when((F.col("words") > n) & (F.col("words") >= s + n - 1), F.array_join(F.slice(word, s, n), " ")) for s, n in runs]
    if inner:
        held = found.where("words > 2").select("lang", F.explode_outer(F.array_compact(F.array(*inner))).alias("phrase"), "a")
        held = held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        found = found.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = whole.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
t AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM p),
u AS (SELECT lang, word, lead(word, 1) OVER piece AS next, lead(word, 2) OVER piece AS third FROM t WINDOW piece AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, phrase, words, count(*)::BIGINT AS a FROM (
    SELECT lang, word AS phrase, 1 AS words FROM u
    UNION ALL SELECT lang, word || ' ' || next, 2 FROM u WHERE next IS NOT NULL
    UNION ALL SELECT lang, word || ' ' || next || ' ' || third, 3 FROM u WHERE third IS NOT NULL)
    GROUP BY lang, phrase, words),
c AS (SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w FROM g WHERE words > 1 AND a >= {LEAST}),
x AS (SELECT c.lang, c.phrase, c.words, c.a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:words], ' ') AS rest
      FROM c, (VALUES (1), (2)) AS v(k) WHERE k < words),
s AS (SELECT x.lang, x.phrase, x.words, x.a, x.k, l.a AS l, r.a AS r, (({SCALE}::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM x JOIN g l ON l.lang = x.lang AND l.phrase = x.head JOIN g r ON r.lang = x.lang AND r.phrase = x.rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
h AS (SELECT lang, phrase, max(a) AS most FROM (
      SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE words = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM c WHERE words = 3) GROUP BY lang, phrase),
o AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE cut = 1 AND (most IS NULL OR 100 * most < {SHARE} * a)),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE words = 1 GROUP BY lang)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {TOP}
"""
