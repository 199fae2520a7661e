"""Near-duplicate detection by MinHash with tensored banding, verified on full shingle sets.

Two collections of ``SIDE`` sub-keys are computed, each sub-key from ``WIDTH`` minhashes; a table key
is a pair with one sub-key from each collection.  SIDE * SIDE tables then need only
2 * SIDE * WIDTH minhashes instead of SIDE * SIDE * 2 * WIDTH.  At similarity 0.8 a pair shares no
table key with probability of at most 2 * (1 - 0.8**WIDTH)**SIDE, 6e-4 by default.

Equal shingle sets form one class, represented once.  A table key can be shared only if both its
sub-keys are, so keys are formed only from sub-keys that occur twice.  Candidates are tested in star
rounds: each bucket's members against one pivot, other pivots in later rounds, and only for members
that are not yet connected; what is left then is tested pair by pair, except for pairs that too few shared shingles
rule out.  So every pair in a common bucket is either tested on its full sets, ruled out, or already in one component,
and a group of thousands of copies costs a few comparisons per member.

Defined results: null or empty texts and texts without words have an empty set and are linked with
nothing; fewer than ``words`` words make one shingle; repeated rows are copies of each other; rows
without id take part, and their component is the smallest id reachable, if any; an empty table gives
an empty result; texts of any length are hashed whole, in pieces; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import _BASE, chunks, keep, mix, partitions, table, utf8, word_hashes

WORDS = 4
PERCENT = 80
SIDE = 8
WIDTH = 2
PLACE = ("node", "comp", "n", "c", "bits")
SKETCH = 512  # bits of the bitmap that rules pairs out
STAR_ROUNDS = 2
_SEEDS = np.random.default_rng(7071).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (bytes, lower-cased already)."""
    h, offset = word_hashes(texts)
    s = h.copy()
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, np.uint64)
        for j in range(words):
            s = s * _BASE + h[j : j + len(s)]
        s = mix(s + np.uint64(words))
    out = []
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = whole * _BASE + x
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(s: np.ndarray) -> np.uint64:
    return mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]


def _sub_keys(sets: list[np.ndarray], side: int, width: int) -> np.ndarray:
    """One row of 2 * side sub-keys for each non-empty set."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), 2 * side), np.uint64)
    for j in range(2 * side * width):
        x = flat * _SEEDS[2 * j]
        x ^= x >> np.uint64(29)
        x *= _SEEDS[2 * j + 1]
        keys[:, j // width] = keys[:, j // width] * _BASE + np.minimum.reduceat(x, begin)
    return mix(keys)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, n_shingles, sub array of 2 * side sub-keys); node is null for an empty set."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))

    def run(batches):
        for batch in batches:
            bodies = [t.lower() for t in utf8(batch.column("body"))]  # bytes: A-Z only
            node, size, sub = [], [], []
            for a, b in chunks(bodies, [len(t) for t in bodies]):
                sets = shingle_sets(bodies[a:b], words)
                full = [s for s in sets if len(s)]
                keys = iter(_sub_keys(full, side, width).view(np.int64).tolist()) if full else iter(())
                for s in sets:
                    size.append(len(s))
                    node.append(int(_node(s).view(np.int64)) if len(s) else None)
                    sub.append(next(keys) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sub, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "sub"],
            )

    return rows.mapInArrow(run, "doc_id long, node long, n_shingles long, sub array<long>")


def _candidates(classes: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """(key, node) for the table keys that more than one class has, and (key, node, place, sub)
    for the first collection's sub-keys: classes that share a table key share one of these."""
    sub = classes.select("node", F.posexplode("sub").alias("place", "value"))
    shared = keep(sub.groupBy("place", "value").agg(F.count("*").alias("n")).where("n > 1").select("place", "value"), "shared")
    mine = sub.join(shared, ["place", "value"])
    left = F.collect_list(F.when(F.col("place") < side, F.struct("place", "value")))
    right = F.collect_list(F.when(F.col("place") >= side, F.struct("place", "value")))
    live = keep(mine.groupBy("node").agg(left.alias("a"), right.alias("b")).where("size(a) > 0 AND size(b) > 0"), "live")
    pairs = live.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
    members = pairs.select(F.xxhash64("a.place", "a.value", "b.place", "b.value").alias("key"), "node")
    members = keep(members, "members")
    twice = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    first = live.select("node", F.explode("a").alias("a")).join(classes.select("node", "sub"), "node")
    first = first.select(F.xxhash64("a.place", "a.value").alias("key"), "node", F.col("a.place").alias("place"), F.slice("sub", 1, side).alias("sub"))
    return keep(members.join(keep(twice, "buckets"), "key"), "candidates"), first


def _sets_of(docs: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(node, items, bits) of the classes in ``nodes`` (node, rep), read from one text of each: the
    shingles, and a bitmap with a bit for each of them (several may share one)."""
    rows = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("body"))
    # a merge join at every size: the side with the texts is shuffled once, never the other one sent
    rows = rows.join(nodes.select("node", "rep").hint("merge"), rows["rep"].eqNullSafe(nodes["rep"])).select("node", "body")

    def run(batches):
        for batch in batches:
            bodies, want = [t.lower() for t in utf8(batch.column("body"))], batch.column("node").to_pylist()
            nodes, items, bits = [], [], []
            for a, b in chunks(bodies, [len(t) for t in bodies]):
                for n, s in zip(want[a:b], shingle_sets(bodies[a:b], words), strict=True):
                    if len(s) and int(_node(s).view(np.int64)) == n:  # ids can repeat
                        nodes.append(n)
                        items.append(s.view(np.int64))
                        has = np.zeros(SKETCH, bool)
                        has[s >> np.uint64(64 - SKETCH.bit_length() + 1)] = True
                        bits.append(np.packbits(has).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["node", "items", "bits"])

    return rows.mapInArrow(run, "node long, items array<long>, bits array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B|, on full sets.

    b's set is sent once to each of the partitions that its partners are spread over, and its
    partners stream past it, so nothing is held but two sets.
    """
    n = partitions(pairs.sparkSession)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(n)))
    left = salted.hint("merge").join(sets, salted["a"] == sets["node"]).select("b", "salt", "a", "items")
    right = salted.select("b", "salt").distinct()
    right = right.hint("merge").join(sets, right["b"] == sets["node"]).select("b", "salt", F.lit(None).cast("long").alias("a"), "items")
    rows = left.union(right).repartition(n, "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches):
        here, mine = None, None
        for batch in batches:
            b, salt, a = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            values, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            got_a, got_b = [], []
            for i in range(len(b)):
                s = values[at[i] : at[i + 1]]
                if a[i] is None:
                    here, mine = (b[i], salt[i]), s.copy()
                elif here == (b[i], salt[i]):
                    both = len(mine) + len(s)
                    if 100 * min(len(mine), len(s)) >= percent * max(len(mine), len(s)):
                        place = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                        common = int((mine[place] == s).sum())
                        if 100 * common >= percent * (both - common):
                            got_a.append(a[i])
                            got_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over ``links`` (a, b)."""
    edges = keep(links.union(links.select("b", "a")).toDF("src", "dst").distinct(), "links")
    label = keep(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("comp")), "label")
    while True:
        seen = label.select(F.col("node").alias("dst"), F.col("comp").alias("c"))
        near = edges.join(seen, "dst").groupBy("src").agg(F.min("c").alias("c"))
        step = label.join(near, label["node"] == near["src"]).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        step = keep(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")), "label")
        label = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return label


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, c, bits) of the classes that can have a link: n shingles, c of them in another class too.

    A link's common shingles are among the c of either side, so c must be at least percent of n.
    """
    own = sets.select("node", F.explode("items").alias("s")).groupBy("s").agg(F.count("*").alias("d"), F.min("node").alias("node")).where("d = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    rows = sets.select("node", F.size("items").cast("long").alias("n"), "bits").join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"), "bits")
    return rows.where(F.col("c") * 100 >= F.col("n") * percent)


def linked_components(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int, side: int) -> DataFrame:
    """(node, comp) for the classes that are linked with another class."""
    members, first = _candidates(classes, side)
    none = docs.sparkSession.createDataFrame([], "node long, comp long")
    nodes = keep(members.select("node").distinct().join(classes.select("node", "rep"), "node"), "nodes")
    if nodes.isEmpty():
        return none
    sets = keep(_sets_of(docs, nodes, key, text, words).dropDuplicates(["node"]), "sets")
    able = keep(_able(sets, percent), "able")
    sets = keep(sets.join(able.select("node").hint("merge"), "node"), "able-sets")
    members = keep(members.join(able, "node"), "able-members")
    links, tested, comp = None, None, none

    def missing(x: str, y: str):  # at least so many shingles of x are not in y
        return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(SKETCH // 64)), F.lit(0))

    # an upper bound of the common shingles must reach percent
    most = F.least(F.col("c"), F.col("o_c"), F.col("n") - missing("bits", "o_bits"), F.col("o_n") - missing("o_bits", "bits"))
    quick = F.least("c", "o_c") * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent
    fits = quick & (most * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent)

    for turn in range(STAR_ROUNDS + 1):
        state = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # the pivot of a bucket has few shingles of its own, so it is close to all that are close
        # to anything; later rounds take another one of those
        central = F.struct(F.floor((1 - F.col("c") / F.col("n")) * 20), F.xxhash64("node", F.lit(turn)))
        pivot = F.min_by(F.struct("node", "comp", "n", "c", "bits"), central)
        open_keys = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot.alias("p")).where("lo < hi")
        open_keys = keep(open_keys.select("key", *[F.col(f"p.{x}").alias(f"o_{x}") for x in PLACE]), "open")
        if open_keys.isEmpty():
            break
        if turn == STAR_ROUNDS:  # what is left, pair by pair (over the few first sub-keys)
            still = state.join(open_keys.select("key"), "key").select("node", "comp").distinct()
            state = keep(first.join(still, "node").join(able, "node"), "rest")
            open_keys = state.select("key", F.col("sub").alias("o_sub"), *[F.col(x).alias(f"o_{x}") for x in PLACE])
        apart = (F.col("comp") != F.col("o_comp")) & fits
        if turn == STAR_ROUNDS:
            # each pair once, under the first sub-key that both have
            again = [(F.col("place") > i) & (F.col("sub")[i] == F.col("o_sub")[i]) for i in range(side)]
            apart = (F.col("node") < F.col("o_node")) & ~reduce(Column.__or__, again) & apart
        pairs = state.join(open_keys, (state["key"] == open_keys["key"]) & apart)
        pairs = pairs.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        found = keep(_verify(pairs, sets, percent), "found")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            comp = components(links)
    return comp


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sigs = keep(signatures(docs, key, text, words, side, width), "signatures")
    classes = sigs.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.first("sub").alias("sub"))
    classes = keep(classes, "classes")
    comp = linked_components(docs, classes, key, text, words, percent, side)
    # classes with copies or links; all other rows are their own component
    linked = classes.join(comp, "node", "left").where("copies > 1 OR comp IS NOT NULL").select("node", F.coalesce("comp", "node").alias("comp"), "rep")
    linked = keep(linked, "linked")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    moved = keep(linked.join(keep(least, "least"), "comp").select("node", "component_id"), "moved")
    rows = sigs.select("doc_id", "node", "n_shingles").join(moved, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with one row of each group; same columns.

    Every row is judged by itself, whatever its id: rows that share an id but not a text stay, copies
    without an id go.  Rows are told apart by a number that is written with them once.
    """
    number = "__row"
    while number in docs.columns:
        number += "_"
    rows = keep(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, number, text, words)
    stay = keep(found.where("kept").select(F.col("doc_id").alias(number)), "kept")
    # ids compress so well that Spark would take a large table for a small one and send it
    return rows.join(stay.hint("merge"), number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 4-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
