"""Operators 11 to 13 against brute force, on small tables with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlens.llm import op11_whitening as o11
from termlens.llm import op12_mixing as o12
from termlens.llm import op13_phrases as o13

SCHEMA = "doc_id long, text string, lang string, source string, bucket string, row int, size string, n long, place string"


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "s", 7, "p") for r in rows] if schema == SCHEMA else rows, schema).repartition(parts)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


# --- 11 ---------------------------------------------------------------------------------------


def brute_whitening(rows):
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in keep)
    x = [[int(np.floor(256 * float(c))) for c in v] + [0] * (size - len(v)) for _, v in keep]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    return keep, x, n, sums, values[::-1], axes[:, ::-1]


def test_components_of_hard_matrices():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((24, 24)))[0]
    made = [
        np.zeros((3, 3)), np.eye(4), np.array([[2.0]]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.diag([1.0, 1, 2, 2, 3]),
        q @ np.diag([1.0] * 12 + [2.0] * 12) @ q.T, q @ np.diag([1.0] * 6 + [1 + 1e-13] * 6 + [3.0] * 12) @ q.T,
        q @ np.diag([0.0] * 20 + [1, 2, 3, 4]) @ q.T, q @ np.diag(np.logspace(0, -12, 24)) @ q.T, np.cov(r.standard_normal((300, 48)).T) * 1e20,
    ]
    for v in made:
        v = (v + v.T) / 2
        values, axes = o11.components(v)
        scale = max(np.abs(v).max(), 1e-300)
        assert np.abs(axes.T @ axes - np.eye(len(v))).max() < 1e-13
        assert np.abs(v @ axes - axes * values).max() / scale < 1e-13
        assert (np.diff(values) <= 1e-13 * scale).all()
        assert np.abs(values[::-1] - np.linalg.eigvalsh(v)).max() / scale < 1e-13


def test_polar_factor():
    r = np.random.default_rng(4)
    a = r.standard_normal((20, 20))
    a = a + a.T
    u, s, vt = np.linalg.svd(a)
    assert np.abs(o11.polar(a) - u @ vt).max() < 1e-12


def test_whitening(spark, tmpdir_path):
    r = np.random.default_rng(5)
    base = r.standard_normal((120, 6)) * [3, 2, 1, 0.5, 0.25, 0.1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[0][1]) for i in range(150)] + [(5, rows[5][1]), (None, rows[6][1])]  # copies, a repeated id, a null id
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] + [0.0] * 5), (404, [float("inf")] + [0.0] * 5), (405, [1.0, -1.0]), (406, [-0.0] * 6)]
    df = spark.createDataFrame([(*x, 3, "c") for x in rows], "vec_id long, embedding array<double>, n int, component string").repartition(4)
    got = o11.op11_whitening(spark, write(df, tmpdir_path, "embeddings")).collect()
    keep, x, n, sums, values, axes = brute_whitening(rows)
    assert len(got) == 4 * len(keep) and {g["n"] for g in got} == {n}
    want = collections.Counter()
    for (i, _), v in zip(keep, x):
        want[(i, sum((n * c - s) ** 2 for c, s in zip(v, sums)))] += 1
    for k in range(4):
        mine = [g for g in got if g["component"] == k + 1]
        assert collections.Counter((g["vec_id"], g["deviation"]) for g in mine) == want
        assert abs(mine[0]["explained"] - values[k] / values.sum()) < 1e-12 and mine[0]["identity_error"] < 1e-9
        w = (np.array(x) - np.array(sums) / n) @ axes[:, k] / np.sqrt(values[k])
        key = lambda rows: sorted(rows, key=lambda t: (t[0] is None, t[0] or 0, abs(t[1])))
        a, b = key([(g["vec_id"], g["whitened"]) for g in mine]), key([(i, y) for (i, _), y in zip(keep, w)])
        sign = np.sign(a[1][1] * b[1][1])
        assert all(abs(p[1] - sign * q[1]) < 1e-9 for p, q in zip(a, b))


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        model = o11.fit(spark.createDataFrame(rows, schema))
        out = o11.transform(spark.createDataFrame(rows, schema), model).collect()
        assert not len(model.values) and all(r["whitening"]["whitened"] == [] for r in out)
    # a flat direction is left out; entries and sums of any size
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], schema)
    model = o11.fit(flat)
    assert len(model.values) == 1 and model.identity_error < 1e-12
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], schema)
    model = o11.fit(huge)
    assert model.sums[0] == -1 and all(r["whitening"]["deviation"] is None for r in o11.transform(huge, model).collect()[:2])


# --- 12 ---------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, closed = sum(sizes.values()), set()
    while True:
        units = sum(weight[s] for s in order if s not in closed)
        words = total - limit * sum(sizes[s] for s in closed)
        new = {s for s in order if s not in closed and limit * sizes[s] * units < words * weight[s]}
        if not new:
            return {s: float(limit * sizes[s]) if s in closed else words * weight[s] / units for s in order}, {s: i % len(weights) for i, s in enumerate(order)}
        closed |= new


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mix(rows, limit=3):
    sizes = collections.defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += n_words(t)
    targets, classes = brute_targets(sizes, limit=limit)
    taken = collections.Counter()
    for source, target in targets.items():
        quota, left = int(np.floor(target + 0.5)), None
        own = sorted(((hashlib.md5(f"{'' if i is None else i}:{n_words(t)}".encode()).hexdigest(), i, n_words(t)) for i, t, _, s in rows if s == source), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
        at = 0
        for _, i, n in own:
            got = sum(max(0, min(n, quota - r * sizes[source] - at)) for r in range(limit))
            taken[(i, n, sizes[source], round(target, 9), got)] += 1
            at += n
    return taken, targets


def mixed_rows():
    r = random.Random(8)
    text = lambda n: " ".join("w%d" % r.randrange(50) for _ in range(n))
    rows = [(i, text(r.randrange(0, 40)), "en", "hot") for i in range(300)]
    rows += [(1000 + i, text(r.randrange(0, 9)), "de", s) for i, s in enumerate(["a", "é", "z", "Z", None, "", "a"] * 6)]
    rows += [(7, "the same text again", None, "copies")] * 40 + [(None, "no id", "en", "a"), (3, None, "en", "b"), (4, "", "en", "b"), (5, " \n\t ", "en", "empty")]
    return rows + [(9000, text(30000), "en", "long"), (9001, "one\x0btwo\x1cthree four", "en", "long")]


def test_mixing(spark, tmpdir_path, monkeypatch):
    rows = mixed_rows()
    folder = write(table(spark, rows), tmpdir_path, "documents")
    want, targets = brute_mix(rows)
    monkeypatch.setattr(o12, "ROWS", 16)  # many buckets
    monkeypatch.setattr(o12, "BLOCK", 7)  # copies told apart in blocks
    for _ in range(2):  # reruns agree
        got = o12.op12_curriculum(spark, folder).collect()
        assert collections.Counter((g["doc_id"], g["size"], g["source_size"], round(g["target"], 9), g["taken"]) for g in got) == want
    position = [g["position"] for g in got if g["taken"]]
    assert position == sorted(position) and all(0 <= p < 1 for p in position)
    assert all(g["position"] is None for g in got if not g["taken"])
    assert abs(sum(targets.values()) - sum(n_words(t) for _, t, _, _ in rows)) < 1e-6
    assert max(g["taken"] - 3 * g["size"] for g in got) == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "a b c d e", "en", s) for s, n in (("a", 400), ("b", 400), ("c", 400)) for i in range(n)]
    plan = o12.plan(table(spark, rows))
    got = o12.occurrences(plan).select("row.doc_id", "words", "position").collect()
    assert [g["position"] for g in got] == sorted(g["position"] for g in got)
    made = plan.select("target", F.explode("takes").alias("t")).collect()
    for target, shape in zip(sorted({m["target"] for m in made}), o12.SHAPES):
        mine = sorted(m["t"]["position"] for m in made if m["target"] == target)
        words = 0
        time = np.linspace(0, 1, 20001)
        height = np.interp(time, *zip(*shape))
        demand = np.concatenate([[0], np.cumsum((height[1:] + height[:-1]) / 2 * np.diff(time))])
        demand = demand / demand[-1] * target
        for p in mine:  # each begins when the demand reaches the words before it
            assert abs(np.interp(p, time, demand) - words) < 1e-3 * target
            words += 5


def test_schedules():
    assert [round(x[4], 12) for x in o12.scaled(((0, 0), (1, 2), (3, 0)))] == [0, round(1 / 3, 12)]
    for bad in (((0, 0), (1, 0)), ((0, 1), (0, 1)), ((0, -1), (1, 3))):
        with pytest.raises(ValueError):
            o12.scaled(bad)


def test_mixing_many_sources_and_none(spark, tmpdir_path):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([0, 1, 1, 2, 50]), "en", f"s{r.randrange(60)}") for i in range(400)]
    got = o12.op12_curriculum(spark, write(table(spark, rows), tmpdir_path, "documents")).collect()
    assert collections.Counter((g["doc_id"], g["size"], g["source_size"], round(g["target"], 9), g["taken"]) for g in got) == brute_mix(rows)[0]
    for rows in ([], [(1, None, None, None)], [(1, "a", "en", "x")]):
        got = o12.op12_curriculum(spark, write(table(spark, rows), tmpdir_path, "documents")).collect()
        assert [(g["doc_id"], g["taken"]) for g in got] == [(r[0], n_words(r[1])) for r in rows]


# --- 13 ---------------------------------------------------------------------------------------


def brute_grams(text, most):
    counts = collections.Counter()
    for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", text.lower()):
        w = re.findall(rb"[^ \t]+", piece)
        counts.update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, most + 1) if i + k <= len(w))
    return counts


def brute_phrases(rows, most=3, least=10, share=50, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang, _ in rows:
        fold = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        counts["und" if lang is None else lang].update(brute_grams(fold.encode(), most))
    out = []
    for lang, c in counts.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        candidates = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        found = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, b" ".join(g), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return out


def grams_of(g):
    out = {}
    for k in range(len(g.levels)):
        for i, path in enumerate(g.paths(k, np.arange(len(g.levels[k][0])))):
            if g.levels[k][2][i]:
                out[tuple(g.labels[j] for j in path)] = int(g.levels[k][2][i])
    return out


def test_automata():
    r = random.Random(1)
    words = [bytes([97 + i]) for i in range(6)] + [b""]
    for _ in range(150):
        most = r.choice([1, 2, 3, 4])
        text = b" ".join(r.choice(words) + (b"," if r.random() < 0.1 else b"") for _ in range(r.randrange(80)))
        want = brute_grams(text, most)
        made = [o13.Grams.counted(t, np.arange(n), most) for t, n in o13.pieces(text, most, r.choice([3, 10, 1000]))]
        if not made:
            continue
        whole = o13.Grams.union(made, most)
        assert grams_of(whole) == want
        automaton = o13.Automaton.unpacked(o13.Automaton.built(whole).packed())
        assert grams_of(automaton.grams()) == want
        keys = [*sorted(want), (b"zz",), (b"a", b"q")]
        assert automaton.walk(keys).tolist() == [want.get(k, 0) for k in keys]
        bounds = sorted({r.choice([*sorted(want), (b"a", b"c"), (b"bb",)]) for _ in range(r.randrange(5))}) if want else []
        ranges, got = o13.Bounds([("x", b) for b in bounds]), {}
        for i, part in whole.cut(bounds):
            part = grams_of(o13.Automaton.built(part).grams())
            assert all(ranges.range("x", g) == i for g in part) and not set(got) & set(part)
            got |= part
        assert got == want


def test_equal_states_are_one():
    tokens = [t for w in b"abcdefgh" for t in (bytes([w]), b"x", b"y", b",")]
    built = o13.Automaton.built(o13.Grams.counted(tokens, np.arange(len(tokens)), 3))
    # the root; one state after all the first words; one after "x"; and those of the part phrases
    assert len(built.first) - 2 <= 5 and built.walk([(b"c", b"x", b"y"), (b"x", b"y"), (b"y",)]).tolist() == [1, 8, 8]


@pytest.fixture(scope="module")
def phrase_rows():
    r = random.Random(6)
    words = ["to", "be", "or", "not", "ÉTÉ", "été", "\x01", "a", "B", "ab", "und", "𝄞"]
    line = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ",\n", "\t"]) for _ in range(n))
    rows = [(i, line(r.randrange(60)), r.choice(["en", "de", None, "und"]), "s") for i in range(80)]
    rows += [(500 + i, "new york city hall is open", "en", "s") for i in range(30)] + [(600, None, "en", "s"), (601, "", None, "s"), (602, " ,;. ", "xx", "s")]
    return rows + [(603, line(9000), "en", "s"), (604, "deep " * 4000, "fr", "s"), (605, "q" * 50000, "fr", "s")]


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, tmpdir_path, monkeypatch, phrase_rows, small):
    if small:  # many shards, ranges and pieces
        monkeypatch.setattr(o13, "RANGE", 2000)
        build = o13.shards
        monkeypatch.setattr(o13, "shards", lambda *a: build(*a, limit=3000))
    got = o13.op13_collocations(spark, write(table(spark, phrase_rows), tmpdir_path, "documents")).collect()
    assert sorted(tuple(g) for g in got) == sorted(brute_phrases(phrase_rows))


def test_phrases_of_other_lengths_and_none(spark, phrase_rows):
    docs = table(spark, phrase_rows)
    for most, least, share, top in ((4, 5, 70, 12), (2, 3, 50, 5)):
        got = o13.collocations(docs, words=most, least=least, share=share, top=top).collect()
        assert sorted(tuple(g) for g in got) == sorted(brute_phrases(phrase_rows, most, least, share, top))
    assert o13.collocations(table(spark, [])).collect() == []
    assert o13.collocations(table(spark, [(1, None, None, None)])).collect() == []


def test_scores_are_exact():
    a, left, right = 3 * 10**12 + 1, 3 * 10**12 + 7, 9 * 10**12 + 1  # products far beyond 64 bits
    assert o13._lowest(a, [(left, right), (left, right)]) == (left, right, 1000000 * a * a // (left * right))
