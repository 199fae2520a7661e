"""Language-model scoring by online logistic context mixing.

Tokens are words (A-Z lower-cased) and one end for each text.  The most frequent training tokens have
a Huffman code; all others share an escape symbol, after which a word counts as its training
frequency plus one among the rare words, with one more place for all unknown words.  Every bit of a
token's code is predicted in several contexts (its place in the code tree alone, with the last token,
with the last two, with the one before the last).  Counts of hashed contexts come from all training
documents.  The predictions are combined in the logistic domain by weights that a gate selects (the
confidence of the two-token context and the depth of the bit), starting from trained weights (fitted on
every bit of all training documents, each predicted from the counts without itself) and learning on through the document after every ``STEP`` bits, and sooner at its beginning; an adaptive map
(by the mixed probability and depth) refines the result: it starts as the trained map, worth ``HOLD`` bits
in each cell, and takes in the document's own bits after every step.  The score is the sum over all bits and escapes in log10, so
probabilities of all tokens sum to one.

The base score is the add-one unigram model.  Counts of the ``TOP`` most frequent words are sent to
the executors, a bounded table; all other words are joined with the full counts.

Defined results: null text is empty text and has the end alone; repeated rows and ids are scored one
by one; with no training row N and V are 0 and every probability is the one unknown place; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import chunks, id_crc, keep, parts, table, word_hashes

TOP = 1 << 18  # words whose counts are sent to the executors, at most
SYMBOLS = 4096  # tokens with a code of their own, with end and escape
SLOTS = 1 << 18  # of each hashed context
FRACTION = 1 << 16  # the fit's sums are added up as whole numbers of 1 / FRACTION, the same in any order
STEP = 512  # bits between two updates of a document's weights
PIECE = 1 << 15  # tokens scored at once; a longer text goes on from the state its last piece left (a step ends there)
EARLY = 32  # bits of a document's first step; each later step is as long as all before it, up to STEP
HOLD = 100.0  # bits that a cell of the trained map is worth against a document's own
RATE = 0.02
ORDERS = 3
INPUTS = ORDERS + 2  # and the code tree, and a constant
GATES = 4 * 3
CELLS = 24
END = np.uint64(0x5851F42D4C957F2D)
ESCAPE = 0  # symbol 0 is the escape, symbol 1 the end


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and the texts' offsets."""
    h, offset = word_hashes(texts)
    n = len(texts)
    return np.insert(h, offset[1:], END), offset + np.arange(n + 1)


def huffman(weights: list[int]) -> list[str]:
    """The code of every symbol."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    fresh, tree = len(weights), {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        tree[fresh] = (x, y)
        heapq.heappush(heap, (a + b, fresh, fresh))
        fresh += 1
    code = {heap[0][2]: ""}
    for n in sorted(tree, reverse=True):  # parents come after their children
        x, y = tree[n]
        code[x], code[y] = code[n] + "0", code[n] + "1"
    return [code[i] for i in range(len(weights))]


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def spans_of(symbol: np.ndarray, offset: np.ndarray, limit: int = PIECE):
    """(from, to, inner offsets, past) of pieces of at most ``limit`` tokens: short texts together, a
    longer one cut, with its last two tokens as the past of the next piece ((0, 0): texts begin here)."""
    for a, b in chunks(offset[1:], np.diff(offset).tolist(), limit):
        first, last = int(offset[a]), int(offset[b])
        if last - first <= limit:
            yield first, last, offset[a : b + 1] - first, (0, 0)
            continue
        past = (0, 0)
        for at in range(first, last, limit):
            to = min(at + limit, last)
            yield at, to, np.array([0, to - at]), past
            past = (int(symbol[to - 1]) + 1, int(symbol[to - 2]) + 1 if to - at > 1 else past[0])


class Vocabulary:
    """Counts of the frequent words, and the code of the most frequent tokens."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, documents: int):
        order = np.lexsort((words, -counts))
        coded = order[: SYMBOLS - 2]
        self.total, self.distinct = total, distinct  # N and V, the end included
        self.rare_total = total - documents - int(counts[coded].sum())
        self.rare_distinct = distinct - (documents > 0) - len(coded)
        symbol = np.zeros(len(words), np.int32)
        symbol[coded] = np.arange(2, len(coded) + 2)
        sort = np.argsort(words)
        self.word, self.count, self.symbol = words[sort], counts[sort], symbol[sort]
        weights = [self.rare_total + 1, documents + 1, *counts[coded].tolist()]
        codes = huffman(weights)
        self.first = np.cumsum([0, *map(len, codes)])
        self.bit = np.array([int(b) for c in codes for b in c], np.uint8)
        nodes: dict[str, int] = {}
        self.node = np.array([nodes.setdefault(c[:i], len(nodes)) for c in codes for i in range(len(c))], np.int32)
        self.depth = np.array([min(2, i // 4) for c in codes for i in range(len(c))], np.int8)
        ones, both = np.full(len(nodes), 0.4), np.full(len(nodes), 0.8)
        w = np.repeat(weights, np.diff(self.first))
        np.add.at(ones, self.node, w * self.bit)
        np.add.at(both, self.node, w)
        self.tree = stretch(ones / both).astype(np.float32)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, training count, is the word in the table) of word hashes; ends are symbol 1."""
        if not len(self.word):
            known = np.zeros(len(h), bool)
            return (h == END).astype(np.int32), np.zeros(len(h), np.int64), known
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        known = self.word[at] == h
        symbol = np.where(known, self.symbol[at], ESCAPE)
        symbol[h == END] = 1
        return symbol, np.where(known, self.count[at], 0), known

    def events(self, symbol: np.ndarray, offset: np.ndarray, past: tuple[int, int] = (0, 0)):
        """One entry for each bit: token, place in the code tables, hashed slots of the contexts.

        ``past`` is what the contexts of the first tokens see: the last token (its symbol plus one,
        0 for none) and the one before it.
        """
        n = self.first[symbol + 1] - self.first[symbol]
        total = int(n.sum())
        token = np.repeat(np.arange(len(symbol)), n)
        place = np.arange(total) + np.repeat(self.first[symbol] - (np.cumsum(n) - n), n)
        one = np.append(0, symbol[:-1] + 1).astype(np.uint32)
        two = np.append([0, 0], symbol[:-2] + 1).astype(np.uint32)[: len(symbol)]
        one[offset[:-1]] = past[0]
        second = offset[:-1] + 1
        two[offset[:-1]] = past[1]
        two[second[second < offset[1:]]] = past[0]
        node = self.node.take(place).astype(np.uint32) * np.uint32(0x9E3779B1)
        a, b = one * np.uint32(0x85EBCA6B) + np.uint32(1), two * np.uint32(0xC2B2AE35) + np.uint32(2)
        slots = []
        for i, past in enumerate((a, a * np.uint32(0x27D4EB2F) ^ b, b)):
            x = node ^ past.take(token)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            slots.append((x & np.uint32(SLOTS - 1)).astype(np.int64) + i * SLOTS)
        return token, place, slots


    def pieces(self, symbol: np.ndarray, offset: np.ndarray):
        """(place, slots) of all bits, a bounded number of tokens at a time."""
        for first, last, inner, past in spans_of(symbol, offset, 4 * PIECE):
            _, place, slots = self.events(symbol[first:last], inner, past)
            yield place, slots


class Own:
    """What documents have added to the refining map (ones and bits by cell), and their bits so far."""

    def __init__(self, docs: int):
        self.ones, self.both = np.zeros((docs, 3 * CELLS), np.float32), np.zeros((docs, 3 * CELLS), np.float32)
        self.done = np.zeros(docs, np.int64)


class Mixer:
    """Hashed context predictions, trained weights, and the refining map."""

    def __init__(self, vocabulary: Vocabulary, zero: np.ndarray, one: np.ndarray):
        self.v = vocabulary
        self.zero, self.one = zero, one  # only for without_own(), not sent
        self.logit, self.trust = self._predict(zero, one)
        self.weight = np.zeros((GATES, INPUTS), np.float32)
        self.weight[:, 0] = 0.4
        self.weight[:, 1:4] = 0.25
        self.map = np.tile(1 / (1 + np.exp(-self._centres())), (3, 1))

    @staticmethod
    def _predict(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return stretch((one + 0.4) / (one + zero + 0.8)).astype(np.float32), np.digitize(one + zero, [1, 4, 32]).astype(np.int8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("zero", "one")}

    @staticmethod
    def _centres() -> np.ndarray:
        return (np.arange(CELLS) - (CELLS - 1) / 2) * 0.75

    def log2(self, symbol: np.ndarray, offset: np.ndarray, adapt: bool = False) -> np.ndarray:
        """log2 of the probability of every token's code; with ``adapt`` the map learns on, too.

        At most ``PIECE`` tokens are held as bits at a time: short texts together, a long one in
        pieces that carry its weights, its map and its last two tokens on.
        """
        out, weight, own = np.empty(len(symbol)), None, None
        for first, last, inner, past in spans_of(symbol, offset):
            if past == (0, 0):  # texts begin here
                weight = np.broadcast_to(self.weight, (len(inner) - 1, GATES, INPUTS)).copy()
                own = Own(len(inner) - 1) if adapt else None
            out[first:last] = self.bits(symbol[first:last], inner, weight=weight, past=past, state=own)
        return out

    def bits(self, symbol: np.ndarray, offset: np.ndarray, weight: np.ndarray | None = None, past: tuple[int, int] = (0, 0), state: Own | None = None, less: tuple[np.ndarray, np.ndarray] | None = None):
        """log2 of the probability of every token's code, documents side by side in steps.

        ``weight`` (documents x gates x inputs) and ``state`` are where the documents start, and are updated;
        without ``state`` the trained map stays as it is and all steps are ``STEP`` bits.  With ``less`` (see
        ``without_own``) they are training texts, and what the fit needs of every bit is returned.
        """
        token, place, slots = self.v.events(symbol, offset, past)
        n = len(token)
        if not n:
            return np.zeros(len(symbol))
        bit = self.v.bit.take(place).astype(np.float32)
        x = np.empty((n, INPUTS), np.float32)
        x[:, 0] = self.v.tree.take(self.v.node.take(place))
        trusts = []
        own_bit = bit.astype(np.int64) * (ORDERS * SLOTS) if less is not None else None
        for i, s in enumerate(slots):
            if less is not None:
                s = s + own_bit
                logit, trust = less[0].take(s), less[1].take(s)
            else:
                logit, trust = self.logit.take(s), self.trust.take(s)
            # contexts never seen fall back on the code tree
            x[:, i + 1] = np.where(trust > 0, logit, x[:, 0])
            trusts.append(trust)
        x[:, -1] = 0.3
        depth = self.v.depth.take(place).astype(np.int64)
        gate = trusts[1].astype(np.int64) * 3 + depth
        begin = np.searchsorted(token, offset)  # events of every document
        mixed = np.empty(n, np.float32)
        docs = len(offset) - 1
        if weight is None:
            weight = np.broadcast_to(self.weight, (docs, GATES, INPUTS)).copy()
        length = np.diff(begin)
        alive = np.flatnonzero(length > 0)
        at = begin[:-1].copy()
        refined = np.empty(n)
        while len(alive):
            step = STEP if state is None else np.clip(state.done[alive], EARLY, STEP)
            size = np.minimum(step, begin[alive + 1] - at[alive])
            row = np.repeat(np.arange(len(alive)), size)
            i = np.arange(size.sum()) + np.repeat(at[alive] - (np.cumsum(size) - size), size)
            slot = row * GATES + gate.take(i)
            xi, at_bit = x.take(i, axis=0), bit.take(i)
            own = weight.take(alive, axis=0).reshape(-1, INPUTS)  # take: much faster than an index
            dot = np.einsum("ij,ij->i", own.take(slot, axis=0), xi)
            mixed[i] = dot
            error = at_bit - 1 / (1 + np.exp(-dot))
            root = np.sqrt(np.maximum(1, np.bincount(slot, minlength=len(own))))
            for j in range(INPUTS):
                own[:, j] += RATE * np.bincount(slot, error * xi[:, j], len(own)) / root
            weight[alive] = own.reshape(-1, GATES, INPUTS)
            if state is not None:
                refined[i] = self._refine(state, alive, row, dot, depth.take(i), at_bit)
                state.done[alive] += size
            at[alive] += size
            alive = alive[at[alive] < begin[alive + 1]]
        if less is not None:
            return x, gate, bit, mixed, depth
        mixed = np.clip(mixed, -9, 9)
        if state is None:
            low, part = self._cell(mixed)
            refined = self.map[depth, low] * (1 - part) + self.map[depth, low + 1] * part
        p = 0.5 / (1 + np.exp(-mixed)) + 0.5 * refined
        p = np.clip(np.where(bit > 0, p, 1 - p), 1e-9, 1)
        return np.bincount(token, np.log2(p), len(symbol))

    @staticmethod
    def _cell(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.clip((mixed / 0.75 + (CELLS - 1) / 2), 0, CELLS - 1.001)
        low = cell.astype(np.int64)
        return low, cell - low

    def _refine(self, state: Own, alive: np.ndarray, row: np.ndarray, dot: np.ndarray, depth: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The refined probabilities of one step's bits, which the documents' maps then take in."""
        low, part = self._cell(np.clip(dot, -9, 9))
        ones, both = state.ones[alive], state.both[alive]
        value = ((HOLD * self.map.reshape(-1) + ones) / (HOLD + both)).reshape(-1)
        slot = row * (3 * CELLS) + depth * CELLS + low
        out = value.take(slot) * (1 - part) + value.take(slot + 1) * part
        for to, share in ((slot, 1 - part), (slot + 1, part)):
            ones += np.bincount(to, share * bit, value.size).reshape(ones.shape)
            both += np.bincount(to, share, value.size).reshape(both.shape)
        state.ones[alive], state.both[alive] = ones, both
        return out

    def without_own(self) -> tuple[np.ndarray, np.ndarray]:
        """Logit and trust of every slot without one of its zeros, and then without one of its ones: what a
        training text's bits are predicted from, as the text is part of the counts."""
        less = [self._predict(np.maximum(0, self.zero - z), np.maximum(0, self.one - (1 - z))) for z in (1, 0)]
        return tuple(np.concatenate(c) for c in zip(*less, strict=True))

    def sums(self, texts: list[bytes], less: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What the fit adds up over all bits of ``texts``: by gate, the gradient and the curvature of their
        log-likelihood at the weights; by cell of the map, ones and bits, at the mixed probabilities that
        the texts have while their weights learn on."""
        step, curve = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
        ones, both, weight = np.zeros(3 * CELLS), np.zeros(3 * CELLS), None
        h, offset = token_hashes(texts)
        symbol = self.v.lookup(h)[0]
        for first, last, inner, past in spans_of(symbol, offset):
            if past == (0, 0):  # texts begin here
                weight = np.broadcast_to(self.weight, (len(inner) - 1, GATES, INPUTS)).copy()
            x, gate, bit, mixed, depth = self.bits(symbol[first:last], inner, weight=weight, past=past, less=less)
            cell = np.clip(np.rint(np.clip(mixed, -9, 9) / 0.75 + (CELLS - 1) / 2), 0, CELLS - 1).astype(int) + depth * CELLS
            ones += np.bincount(cell, bit, 3 * CELLS)
            both += np.bincount(cell, minlength=3 * CELLS)
            order = np.argsort(gate.astype(np.int8), kind="stable")
            x, bit = x.take(order, axis=0), bit.take(order)
            cut = np.cumsum([0, *np.bincount(gate, minlength=GATES)])
            for g in range(GATES):
                xs = x[cut[g] : cut[g + 1]]
                p = 1 / (1 + np.exp(-(xs @ self.weight[g])))
                step[g] += (bit[cut[g] : cut[g + 1]] - p) @ xs
                curve[g] += xs.T @ (xs * (p * (1 - p))[:, None])
        return np.concatenate([step.ravel(), curve.ravel(), ones, both])

    def fit(self, sums: np.ndarray) -> None:
        """Weights (one Newton step) and map from the sums over all training texts."""
        step, curve, ones, both = np.split(sums, np.cumsum([GATES * INPUTS, GATES * INPUTS**2, 3 * CELLS]))
        step, curve = step.reshape(GATES, INPUTS, 1), curve.reshape(GATES, INPUTS, INPUTS)
        self.weight += np.linalg.solve(curve + np.eye(INPUTS), step)[..., 0].astype(np.float32)  # a gate of few bits stays near its start
        self.map = ((ones + 20 * self.map.reshape(-1)) / (both + 20)).reshape(3, CELLS)


def _lower(batch, limit: int = 1 << 20):
    """(rows of the batch, their texts with A-Z lower-cased) in parts of about ``limit`` bytes."""
    for rows, texts in parts(batch, "body", limit):
        yield rows, [t.lower() for t in texts]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, ends not included; words by their 64-bit hash."""

    def run(batches):
        for batch in batches:
            for _, bodies in _lower(batch):
                word, n = np.unique(word_hashes(bodies)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text).alias("body")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> tuple[Mixer, DataFrame]:
    """The model, and the table of all words' counts (word, n), from all rows where ``learn`` holds (``key`` is no input)."""
    spark = docs.sparkSession
    rows = docs.where(learn).select(F.col(text).alias("body"))
    counts = keep(word_counts(rows, "body"), "counts")
    documents = rows.count()
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (size["n"] or 0) + documents, size["v"] + (documents > 0)
    # the smallest count such that at most TOP words have it or more (there are fewer different counts
    # than twice the root of the number of words)
    steps = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, words = steps[0]["n"] + 1 if steps else 1, 0
    for r in steps:
        if words + r["words"] > TOP:
            break
        least, words = r["n"], words + r["words"]
    top = counts.where(F.col("n") >= least).toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    vocabulary = Vocabulary(word, n, total, distinct, documents)
    sent = spark.sparkContext.broadcast(vocabulary)

    def contexts(batches):
        zero, one = np.zeros(ORDERS * SLOTS, np.int64), np.zeros(ORDERS * SLOTS, np.int64)
        v = sent.value
        for batch in batches:
            for _, bodies in _lower(batch):
                h, offset = token_hashes(bodies)
                for place, slots in v.pieces(v.lookup(h)[0], offset):
                    bit = v.bit[place].astype(np.int64)
                    for i, s in enumerate(slots):
                        both = np.bincount((s - i * SLOTS) * 2 + bit, minlength=2 * SLOTS)
                        zero[i * SLOTS : (i + 1) * SLOTS] += both[::2]
                        one[i * SLOTS : (i + 1) * SLOTS] += both[1::2]
        slot = np.flatnonzero(zero + one)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(zero[slot]), pa.array(one[slot])], names=["slot", "zero", "one"])

    summed = rows.mapInArrow(contexts, "slot int, zero long, one long").groupBy("slot").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    zero, one = np.zeros(ORDERS * SLOTS), np.zeros(ORDERS * SLOTS)
    slot = summed.column("slot").to_numpy()
    zero[slot], one[slot] = summed.column("zero").to_numpy(), summed.column("one").to_numpy()
    model = Mixer(vocabulary, zero, one)
    learner = spark.sparkContext.broadcast((model, model.without_own()))

    def fitted(batches):
        m, less = learner.value
        total = 0.0
        for batch in batches:
            for _, bodies in _lower(batch):
                total = total + m.sums(bodies, less)
        amount = np.rint(np.atleast_1d(total) * FRACTION).astype(np.int64)
        at = np.flatnonzero(amount).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(amount[at])], names=["place", "amount"])

    sums = np.zeros(GATES * INPUTS * (INPUTS + 1) + 2 * 3 * CELLS)
    for r in rows.mapInArrow(fitted, "place int, amount long").groupBy("place").agg(F.sum("amount").alias("amount")).collect():
        sums[r["place"]] = r["amount"] / FRACTION
    model.fit(sums)
    return model, counts


def score(docs: DataFrame, model: Mixer, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    v = model.v
    whole = math.log10(v.total + v.distinct + 1)
    rare = math.log10(v.rare_total + v.rare_distinct + 1)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))

    def run(batches):
        m = sent.value
        for batch in batches:
            for part, bodies in _lower(batch):
                size = len(bodies)
                h, offset = token_hashes(bodies)
                symbol, count, known = m.v.lookup(h)
                end = h == END
                n_docs = int(m.v.total > 0) and m.v.total - m.v.rare_total - int(m.v.count[m.v.symbol > 1].sum())
                count = np.where(end, n_docs, count)
                done = known | end
                owner = np.repeat(np.arange(size), np.diff(offset))
                escaped = done & (symbol == ESCAPE)
                mixed = np.bincount(owner, m.log2(symbol, offset, adapt=True), size) * math.log10(2)
                mixed += np.bincount(owner, np.where(escaped, np.log10(count + 1) - rare, 0), size)
                base = np.bincount(owner, np.where(done, np.log10(count + 1) - whole, 0), size)
                seen = np.bincount(owner, done & (count > 0), size).astype(np.int64)
                # words outside the table, with their number in the text
                left = np.flatnonzero(~done)
                pair = np.stack([owner[left].astype(np.uint64), h[left]], axis=1)
                pair, n = np.unique(pair, axis=0, return_counts=True) if len(left) else (pair, np.zeros(0, np.int64))
                cut = pa.array(np.searchsorted(pair[:, 0], np.arange(size + 1, dtype=np.uint64)).astype(np.int32))
                words = pa.ListArray.from_arrays(cut, pa.array(pair[:, 1].copy().view(np.int64)))
                times = pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32)))
                lengths = pa.array([len(t) for t in bodies], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), pa.array(np.diff(offset)), pa.array(seen), pa.array(base), pa.array(mixed), lengths, words, times],
                    names=["row_id", "doc_id", "n_tokens", "known", "base", "mixed", "n_bytes", "words", "times"],
                )

    first = keep(rows.mapInArrow(run, "row_id long, doc_id long, n_tokens long, known long, base double, mixed double, n_bytes long, words array<long>, times array<int>"), "scored")
    rest = first.select("row_id", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))).alias("x")).select("row_id", "x.word", "x.times")
    met = rest.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gain = F.col("times") * F.log10(F.col("n") + 1)
    more = met.groupBy("row_id").agg(F.sum("times").alias("r"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(gain).alias("g"))
    rows = first.drop("words", "times").join(more, "row_id", "left").na.fill(0, ["r", "k", "g"])
    mixed = F.col("mixed") + F.col("g") - F.col("r") * rare
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.col("k")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.col("g") - F.col("r") * whole, 6).alias("base_score"),
        F.round(mixed, 6).alias("score"),
        F.round(-mixed * math.log2(10) / F.greatest("n_bytes", F.lit(1)), 6).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from ids whose crc32 is not 2 modulo 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc("doc_id") % 7 == 2
    model, counts = train(docs, ~held_out)
    return score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
