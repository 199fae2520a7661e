"""Dictionary analysis of a text column: the core operator (AGG-1..5, FN-12, JN-1/2).

Default plan ("row-local", shape A): everything happens inside one projection
over the input rows -- no shuffle, no join back, no Python -- so it keeps the
input partitioning, works unchanged on a streaming DataFrame, and scales with
the number of executors.  The vocabulary is embedded as hash-set literals
(Catalyst turns ``IN`` lists into ``InSet``), which is only done below a
checked entry count.  Larger vocabularies go to the join plan in
:mod:`termlens.operators.matches`.

Per row::

    tk      = lower(text) -> token runs                     (array<string>)
    hits    = tokens/n-grams that match ANY entry            (occurrences kept)
    pairs   = run-length of sorted hits -> (term, occ)       (distinct terms)
    per category c, over pairs only (small):
        e_c(term) = exact weight, m_c(term) = sum of matching prefix weights
        word_count      = sum occ * (e_c + m_c)     (tokens convention)
                          sum e_c + occ * m_c       (legacy "types" convention)
        detected_words  = {term: occ | e_c + m_c > 0}
        word_perc       = word_count / n_tokens, 0.0 when there are no tokens

Every token is tested once, for whether an entry can match there; words and
n-grams (only of orders some entry can match) are built at these positions alone
(exact pruning).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.errors import AnalysisConfigError, NoTextColumnError
from termlens.functions.naming import uniquify
from termlens.functions.text import (
    DEFAULT_MAX_N,
    text_column_of,
    tokenize,
    with_run_length,
    word_share,
)
from termlens.plans.strategy import balance
from termlens.operators.vocabulary import LiteralVocabulary, Vocabulary, collect_literal_vocabulary, needed_orders

# Above this many vocabulary entries the row-local plan stops embedding literals
# and the join plan is used (measured: cost grows with literal count).
LITERAL_THRESHOLD = 10_000

FEW = 8  # prefixes up to this number are compared one by one, more are looked up by their lengths

CONVENTIONS = ("tokens", "types")

N_TOKENS = "n_tokens"
N_TYPES = "n_types"
COUNT_SUFFIX = "_word_count"
PERC_SUFFIX = "_word_perc"
DETECTED_SUFFIX = "_detected_words"


def analysis_column_names(categories: list[str]) -> list[str]:
    out = [N_TOKENS, N_TYPES]
    for c in categories:
        out += [f"{c}{COUNT_SUFFIX}", f"{c}{PERC_SUFFIX}", f"{c}{DETECTED_SUFFIX}"]
    return out


# --------------------------------------------------------------------------- #
# predicate builders over literal sets
# --------------------------------------------------------------------------- #
def _by_len(keys: dict[str, int]) -> dict[int, dict[int, list[str]]]:
    """{key: weight} -> {key_len: {weight: [keys]}}."""
    out: dict[int, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for k, w in keys.items():
        out[len(k)][w].append(k)
    return out


def _in(c: Column, keys) -> Column:
    keys = sorted(keys)
    return c.isin(keys) if keys else F.lit(False)


def _shortest(keys) -> list[str]:
    """The keys that no other key is a prefix of: what begins with some key begins with one of these."""
    out: list[str] = []
    for k in sorted(keys):
        if not out or not k.startswith(out[-1]):
            out.append(k)
    return out


def _any_prefix(term: Column, keys) -> Column:
    keys = _shortest(keys)
    if len(keys) <= FEW:
        return _or([F.startswith(term, F.lit(k)) for k in keys])
    return _or([_in(F.substring(term, 1, L), ks) for L, ks in _same_length(keys).items()])


def _same_length(keys) -> dict[int, list[str]]:
    out: dict[int, list[str]] = defaultdict(list)
    for k in keys:
        out[len(k)].append(k)
    return dict(sorted(out.items()))


def _any(term: Column, exact, prefix) -> Column:
    """Whether some entry matches ``term``; exact entries that a prefix covers are not looked up."""
    short = _shortest(prefix)
    by_length = [(n, set(ks)) for n, ks in _same_length(short).items()]
    left = [k for k in exact if not any(k[:n] in ks for n, ks in by_length)]
    return _or([c for c in (_any_prefix(term, short) if short else None, _in(term, left) if left else None) if c is not None])


def _or(conds: list[Column]) -> Column:
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _weighted(term: Column, keys: dict[str, int], prefix: bool) -> Column:
    """Sum of weights of the entries matching ``term`` (bigint, 0 if none)."""
    parts: list[Column] = []
    if prefix and len(keys) <= FEW:
        parts = [F.when(F.startswith(term, F.lit(k)), F.lit(w)).otherwise(F.lit(0)) for k, w in sorted(keys.items())]
    elif prefix:
        for L, by_w in sorted(_by_len(keys).items()):
            probe = F.substring(term, 1, L)
            for w, ks in sorted(by_w.items()):
                parts.append(F.when(_in(probe, ks), F.lit(w)).otherwise(F.lit(0)))
    else:
        by_w: dict[int, list[str]] = defaultdict(list)
        for k, w in keys.items():
            by_w[w].append(k)
        for w, ks in sorted(by_w.items()):
            parts.append(F.when(_in(term, ks), F.lit(w)).otherwise(F.lit(0)))
    if not parts:
        return F.lit(0).cast("bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("bigint")


def _starts(lv: LiteralVocabulary, n: int) -> tuple[set[str], set[str]]:
    """(words, prefixes): the first token of every order-``n`` n-gram that some multi entry matches is
    one of the words or begins with one of the prefixes."""
    words = {k.split()[0] for k in lv.keys(None, True, "exact") if len(k.split()) == n}
    prefixes: set[str] = set()
    for k in lv.keys(None, True, "prefix"):
        parts = k.split()
        if len(parts) > n:
            continue
        if len(parts) >= 2:
            words.add(parts[0])
        else:
            prefixes.add(k)
    return words, prefixes


def _start_filter(lv: LiteralVocabulary, n: int):
    """First-token test for order-``n`` n-grams that some multi entry could match."""
    words, prefixes = _starts(lv, n)
    return lambda t: _any(t, words, prefixes)


# --------------------------------------------------------------------------- #
# the operator
# --------------------------------------------------------------------------- #
def analyze(
    df: DataFrame,
    text_col: str,
    vocab: Vocabulary,
    max_n: int = DEFAULT_MAX_N,
    convention: str = "tokens",
    with_detected: bool = True,
    plan: str = "auto",
    key_col: str | None = None,
    literal_threshold: int = LITERAL_THRESHOLD,
    keep_columns: bool = True,
) -> DataFrame:
    """Original columns (if ``keep_columns``) + ``n_tokens, n_types`` + per category
    ``{c}_word_count, {c}_word_perc, {c}_detected_words``.

    ``plan``: ``"auto"`` (row-local up to ``literal_threshold`` entries, else join),
    ``"rowlocal"`` or ``"join"``.  Both give the same rows for the same input: one per input row,
    whatever its key.  ``key_col`` is the column kept when ``keep_columns`` is false; it may hold
    nulls and repeated values.  The row-local plan embeds the entries as literals, so asking for it
    by name with more than ``literal_threshold`` entries is an error, as is a stream with such a
    dictionary (see :func:`termlens.streaming.incremental.analyze_arrivals`).
    """
    if text_col not in df.columns:
        raise NoTextColumnError(f"text column {text_col!r} not in {df.columns}")
    if convention not in CONVENTIONS:
        raise AnalysisConfigError(f"convention must be one of {CONVENTIONS}")
    lv = None
    if plan in ("auto", "rowlocal"):
        lv = collect_literal_vocabulary(vocab, literal_threshold)
    if lv is None:
        from termlens.operators.matches import analyze_by_join

        if plan == "rowlocal" or df.isStreaming:
            raise AnalysisConfigError(
                f"the row-local plan takes at most {literal_threshold} entries; "
                "use plan='join', or analyze_arrivals for a stream"
            )
        return analyze_by_join(df, text_col, vocab, key_col, max_n, convention, with_detected, keep_columns)
    return _analyze_rowlocal(df, text_col, lv, max_n, convention, with_detected, keep_columns, key_col)


def _analyze_rowlocal(
    df: DataFrame,
    text_col: str,
    lv: LiteralVocabulary,
    max_n: int,
    convention: str,
    with_detected: bool,
    keep_columns: bool,
    key_col: str | None,
) -> DataFrame:
    df = balance(df)
    cats = list(lv.categories)
    orders = needed_orders(lv, max_n)
    originals = list(df.columns) if keep_columns else ([key_col] if key_col else [])
    out_names = _output_names(originals, cats)
    tmp = "__tl_"

    all_es = lv.keys(None, False, "exact")
    all_em = lv.keys(None, True, "exact")
    all_ps = lv.keys(None, False, "prefix")
    all_pm = lv.keys(None, True, "prefix")

    # level 1: tokens
    base = df.select(*[F.col(f"`{c}`") for c in originals], tokenize(text_column_of(df, text_col)).alias(f"{tmp}tk"))
    tk = F.col(f"{tmp}tk")

    # level 2: where a match can begin (each token is tested once), then sizes + union hits (each occurrence kept)
    if orders and (all_em or all_pm):
        starts = [_starts(lv, n) for n in orders]
        words = set(all_es).union(*(w for w, _ in starts))
        prefixes = set(all_ps).union(*(p for _, p in starts))
        begins = F.transform(tk, lambda t, i: F.when(_any(t, words, prefixes), i))
        base = base.select(*[F.col(f"`{c}`") for c in originals], tk, F.filter(begins, lambda i: i.isNotNull()).alias(f"{tmp}at"))
        hit_parts = []
        if all_es or all_ps:
            hit_parts.append(F.filter(_grams_at(tk, F.col(f"{tmp}at"), 1), lambda t: _any(t, all_es, all_ps)))
        for n in orders:
            hit_parts.append(F.filter(_grams_at(tk, F.col(f"{tmp}at"), n), lambda g: _any(g, all_em, all_pm)))
        hits = hit_parts[0] if len(hit_parts) == 1 else F.concat(*hit_parts)
    elif all_es or all_ps:
        hits = F.filter(tk, lambda t: _any(t, all_es, all_ps))
    else:
        hits = F.array().cast("array<string>")

    sized = base.select(
        *[F.col(f"`{c}`") for c in originals],
        F.size(tk).cast("bigint").alias(f"{tmp}n_tokens"),
        F.size(F.array_distinct(tk)).cast("bigint").alias(f"{tmp}n_types"),
        hits.alias(f"{tmp}hits"),
    )
    keep = originals + [f"{tmp}n_tokens", f"{tmp}n_types"]
    lvl2 = with_run_length(sized, F.col(f"{tmp}hits"), f"{tmp}pairs", keep)
    pairs = F.col(f"{tmp}pairs")

    # level 3: per category matched pairs with weights
    per_cat = []
    for i, c in enumerate(cats):
        es = {**lv.keys(c, False, "exact"), **lv.keys(c, True, "exact")}
        ps = lv.keys(c, False, "prefix")
        pm = lv.keys(c, True, "prefix")

        # most pairs are of other categories: a test without weights first
        mine = F.filter(pairs, _matcher(es, ps, pm))
        cp = F.filter(F.transform(mine, _annotator(es, ps, pm)), lambda x: (x["e"] + x["m"]) > 0)
        per_cat.append(cp.alias(f"{tmp}cp{i}"))

    lvl3 = lvl2.select(*[F.col(f"`{c}`") for c in originals], F.col(f"{tmp}n_tokens"), F.col(f"{tmp}n_types"), *per_cat)
    return _finish(lvl3, originals, cats, out_names, convention, with_detected, tmp)


def _grams_at(tk: Column, at: Column, n: int) -> Column:
    """The order-``n`` n-grams at the positions ``at``; null where the tokens end before."""
    space = F.lit(" ")
    return F.transform(at, lambda i: F.concat(*[c for k in range(n) for c in ((space, F.get(tk, i + k)) if k else (F.get(tk, i),))]))


def _matcher(es: dict[str, int], ps: dict[str, int], pm: dict[str, int]):
    """Lambda ``pair -> boolean``: true for every pair that an entry of the category can match."""
    return lambda p: _any(p["term"], es, {**ps, **pm})


def _annotator(es: dict[str, int], ps: dict[str, int], pm: dict[str, int]):
    """Lambda ``pair -> struct(term, occ, e, m)`` for one category (bound by closure:
    PySpark counts default arguments as lambda parameters)."""

    def annotate(p):
        term = p["term"]
        is_gram = F.instr(term, " ") > 0
        e = _weighted(term, es, prefix=False) if es else F.lit(0).cast("bigint")
        m_parts = []
        if ps:
            m_parts.append(F.when(~is_gram, _weighted(term, ps, prefix=True)).otherwise(F.lit(0).cast("bigint")))
        if pm:
            m_parts.append(F.when(is_gram, _weighted(term, pm, prefix=True)).otherwise(F.lit(0).cast("bigint")))
        m = m_parts[0] if m_parts else F.lit(0).cast("bigint")
        for x in m_parts[1:]:
            m = m + x
        return F.struct(term.alias("term"), p["occ"].alias("occ"), e.alias("e"), m.alias("m"))

    return annotate


def _finish(lvl3, originals, cats, out_names, convention, with_detected, tmp) -> DataFrame:
    # level 4: counts and detected maps; level 5: shares reuse the materialised counts
    n_tok = F.col(f"{tmp}n_tokens")
    cols = [F.col(f"`{c}`") for c in originals] + [n_tok, F.col(f"{tmp}n_types")]
    for i, c in enumerate(cats):
        cp = F.col(f"{tmp}cp{i}")
        if convention == "tokens":
            cnt = F.aggregate(cp, F.lit(0).cast("bigint"), lambda a, x: a + x["occ"] * (x["e"] + x["m"]))
        else:
            cnt = F.aggregate(cp, F.lit(0).cast("bigint"), lambda a, x: a + x["e"] + x["occ"] * x["m"])
        cols.append(cnt.alias(f"{tmp}cnt{i}"))
        if with_detected:
            cols.append(F.map_from_entries(F.transform(cp, lambda x: F.struct(x["term"], x["occ"]))).alias(f"{tmp}det{i}"))
    lvl4 = lvl3.select(*cols)
    out = [F.col(f"`{c}`") for c in originals]
    out += [n_tok.alias(out_names[N_TOKENS]), F.col(f"{tmp}n_types").alias(out_names[N_TYPES])]
    for i, c in enumerate(cats):
        cnt = F.col(f"{tmp}cnt{i}")
        out.append(cnt.alias(out_names[f"{c}{COUNT_SUFFIX}"]))
        out.append(word_share(cnt, n_tok).alias(out_names[f"{c}{PERC_SUFFIX}"]))
        if with_detected:
            out.append(F.col(f"{tmp}det{i}").alias(out_names[f"{c}{DETECTED_SUFFIX}"]))
    return lvl4.select(*out)


def _output_names(originals: list[str], cats: list[str]) -> dict[str, str]:
    """Analysis names, made unique against the originals (case-insensitively)."""
    taken = list(originals)
    out = {}
    for n in analysis_column_names(cats):
        u = uniquify(n, taken)
        taken.append(u)
        out[n] = u
    return out


def analysis_frame(df: DataFrame, text_col: str, vocab: Vocabulary, key_col: str, **kw) -> DataFrame:
    """Only ``key_col`` + the analysis columns (the reference's analysis table)."""
    return analyze(df, text_col, vocab, key_col=key_col, keep_columns=False, **kw)
