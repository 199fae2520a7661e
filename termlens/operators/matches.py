"""Join plan (shape B): dictionary matches via equi-joins, for dictionaries of any size.

A dictionary whose measured size is under ``broadcast_limit_bytes`` is sent to all tasks (a broadcast
join): every row's tokens are staged once next to its columns, and an Arrow function matches the distinct
terms of a bounded number of rows to it (:func:`_row_hits`).  No n-gram is written or shuffled, and no
text moves.  For larger dictionaries:

1. The input is staged once: every row gets an internal id and, next to its columns, its token
   counts and its *term bag* (distinct terms with occurrences).  The staged table is written under
   the shared checkpoint folder, so ids never change when a task runs again, and a user's key
   column is needed nowhere: null and repeated keys are ordinary values.
2. The distinct terms of the corpus (counted with map-side combine) are matched to the dictionary,
   each once, by equi-joins only: exact entries on the term; prefixes on ``substring(term, 1, L)``
   for the lengths ``L`` that the dictionary holds for the term's first character; one-word
   prefixes of phrases ("new *") on the distinct *first tokens* of the n-grams; longer ones for
   the lengths held for their first token.
3. The bag meets the matched terms in one equi-join.  Matched terms are broadcast only when their
   measured size is under ``broadcast_limit_bytes``; otherwise the frequent ones (more than one
   shuffle partition's share of the bag, hence at most as many as there are partitions) are
   broadcast and only the rest of the bag is shuffled, so no hot term fills a task.
4. :func:`analyze_by_join` needs every row's hits next to its columns.  When the matched terms are
   under the limit, each row looks its bag up where it is: no text moves, nothing is joined or
   shuffled above the staged scan.  Otherwise hits are summed per (row, category) and attached by the
   internal id; columns that the caller drops are pruned from the staged scan and never move.

:func:`term_matches` gives one row per (row, entry) hit: ``key, category, term, occ, weight,
match_kind``.  ``occ`` is the term's occurrences in the row and ``weight`` the entry's multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlens.functions.text import all_ngrams, explode_rows, ngrams, text_column_of, tokenize, with_run_length, word_share
from termlens.operators.vocabulary import Vocabulary, checked_categories, needed_orders
from termlens.plans.strategy import balance
from termlens.session import stage_table

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# The first-token test inside the row is built from literals; above these counts n-grams are
# built at every position.  The rows of the result are the same either way.
PRUNE_LIMIT = 50_000
MAX_PRUNE_PREFIX_LENGTHS = 4

ROW_ID, ROW_KEY, BAG, TOKENS, TYPES = "__tl_row", "__tl_key", "__tl_bag", "__tl_n_tokens", "__tl_n_types"
WORDS = "__tl_words"


CHUNK_TOKENS = 1 << 19  # tokens matched at once, at most (a longer row goes alone)


def stage_tokens(df: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` + the tokens of every row, written once and read back."""
    df = balance(df)
    kept = [F.col(f"`{c}`") for c in columns]
    return stage_table(df.select(*kept, tokenize(text_column_of(df, text_col)).alias(WORDS)), "tokens")


def _spans(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``times[i]`` of them) for every i, one after the other."""
    return np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())


def _first_words(keys: pa.Array) -> pa.Array:
    return pc.list_element(pc.split_pattern(keys, " ", max_splits=1), 0) if len(keys) else keys


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


class _Keys:
    """Dictionary keys of one kind and the entries (rows of the dictionary table) that have them."""

    def __init__(self, entries: pa.Table, rows: np.ndarray, prefix: bool):
        self.groups = []
        length = entries.column("key_len").to_numpy()[rows] if prefix else np.zeros(len(rows), int)
        for n in np.unique(length):
            here = rows[length == n]
            keys = entries.column("key").take(pa.array(here)).combine_chunks().dictionary_encode()
            code = keys.indices.to_numpy()
            ends = np.searchsorted(np.sort(code), np.arange(len(keys.dictionary) + 1))
            self.groups.append((int(n) if prefix else None, keys.dictionary, ends, here[np.argsort(code, kind="stable")]))

    def find(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``terms``, entry) of every match."""
        places, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, keys, ends, rows in self.groups if len(terms) else ():
            probe = terms if n is None else pc.utf8_slice_codeunits(terms, 0, n)
            at = pc.fill_null(pc.index_in(probe, value_set=keys), -1).to_numpy()
            hit = np.flatnonzero(at >= 0)
            times = ends[at[hit] + 1] - ends[at[hit]]
            places.append(np.repeat(hit, times))
            entries.append(rows[_spans(ends[at[hit]], times)])
        return np.concatenate(places), np.concatenate(entries)


class _Dictionary:
    """The entries (key, key_len, n_words, is_multi, match_kind, category, weight) as a task looks them up."""

    def __init__(self, table: pa.Table, cats: list[str], orders: list[int]):
        self.orders = orders
        multi = table.column("is_multi").to_numpy()
        prefix = pc.equal(table.column("match_kind"), "prefix").to_numpy()
        # a key without a space starts an n-gram exactly when it starts the first token
        spaced = pc.match_substring(table.column("key"), " ").to_numpy()
        rows = lambda mask, kind: _Keys(table, np.flatnonzero(mask), kind)
        self.firsts = pc.unique(_first_words(table.column("key").filter(pa.array(multi & spaced)).combine_chunks()))
        self.words, self.starts = rows(~multi & ~prefix, False), rows(~multi & prefix, True)
        self.grams, self.openers, self.longer = rows(multi & ~prefix, False), rows(multi & prefix & ~spaced, True), rows(multi & prefix & spaced, True)
        place = {c: i for i, c in enumerate(cats)}
        self.category = np.array([place[c] for c in table.column("category").to_pylist()], np.int64)
        self.weight, self.prefix = table.column("weight").to_numpy(), prefix

    def match(self, code: np.ndarray, words: pa.Array, row: np.ndarray, size: np.ndarray):
        """Hits of some rows: (terms, row, term, occ, entry), sorted by row; ``code`` numbers the tokens' ``words``."""
        word, entry = self.words.find(words)
        more = self.starts.find(words)
        found = [(np.concatenate([word, more[0]]), np.concatenate([entry, more[1]]))]
        terms, at_row, at_term = [words], [row], [code]
        opened, opener = self.openers.find(words)
        order = np.argsort(opened, kind="stable")
        opened, opener = opened[order], opener[order]
        ends = np.searchsorted(opened, np.arange(len(words) + 1))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # tokens from here to the end of the row
        # n-grams are only built where some multi-word entry can start
        begins = pc.is_in(words, value_set=self.firsts).to_numpy(zero_copy_only=False) | (np.diff(ends) > 0)
        where = np.flatnonzero(begins[code])
        gram, base, text = code[where].astype(np.int64), len(words), words
        first = np.arange(len(words))  # the first word of every term
        for n in range(2, max(self.orders, default=1) + 1):
            fits = left[where] >= n
            where = where[fits]
            pair, gram = np.unique(gram[fits] * len(words) + code[where + n - 1], return_inverse=True)
            before, last = np.divmod(pair, max(1, len(words)))
            text = pc.binary_join_element_wise(text.take(pa.array(before)), words.take(pa.array(last)), " ")
            first = first[before]
            if n not in self.orders:
                continue
            times = ends[first + 1] - ends[first]
            parts = [self.grams.find(text), self.longer.find(text), (np.repeat(np.arange(len(first)), times), opener[_spans(ends[first], times)])]
            found.append((np.concatenate([p[0] for p in parts]) + base, np.concatenate([p[1] for p in parts])))
            terms.append(text)
            at_row.append(row[where])
            at_term.append(gram + base)
            base += len(text)
        term, entry = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(term, kind="stable")
        term, entry = term[order], entry[order]
        ends = np.searchsorted(term, np.arange(base + 1))
        at_row, at_term = np.concatenate(at_row), np.concatenate(at_term)
        hit = ends[at_term + 1] > ends[at_term]
        pair, occ = np.unique(at_row[hit] * base + at_term[hit], return_counts=True)
        at_row, at_term = np.divmod(pair, max(1, base))
        times = ends[at_term + 1] - ends[at_term]
        expand = lambda a: np.repeat(a, times)
        return pa.concat_arrays(terms), expand(at_row), expand(at_term), expand(occ), entry[_spans(ends[at_term], times)]


def _row_hits(dictionary: _Dictionary, words: pa.Array) -> Iterator[tuple]:
    """(first row, past the last, distinct tokens of every row, hits by :meth:`_Dictionary.match`) of all rows
    of the token lists ``words``, a bounded number of tokens at a time."""
    ends = words.offsets.to_numpy()
    begin = 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHUNK_TOKENS, side="right")) - 1)
        some = words.slice(begin, end - begin)
        tokens = some.flatten().cast(pa.string()).dictionary_encode()
        code, size = tokens.indices.to_numpy().astype(np.int64), np.diff(ends[begin : end + 1])
        row = np.repeat(np.arange(end - begin), size)
        n = max(1, len(tokens.dictionary))
        types = np.bincount(_distinct(row * n + code) // n, minlength=end - begin)
        yield begin, end, types, dictionary.match(code, tokens.dictionary, row, size)
        begin = end


def _sent(v: DataFrame, cats: list[str], orders: list[int]):
    """The dictionary table (of checked size) on all tasks."""
    table = v.select("key", "key_len", "is_multi", "match_kind", "category", F.col("weight").cast("bigint").alias("weight")).toArrow().combine_chunks()
    names = ["key", "match_kind", "category"]
    table = table.cast(pa.schema([pa.field(f.name, pa.string()) if f.name in names else f for f in table.schema]))
    return v.sparkSession.sparkContext.broadcast(_Dictionary(table, cats, orders))


def _counted(words: Column, sent, width: int, convention: str, with_detected: bool) -> Column:
    """``struct<types, counts, detected>``: a row's distinct tokens, and every category's counts and terms."""
    legacy = convention != "tokens"

    @F.arrow_udf("struct<types:bigint,counts:array<bigint>,detected:array<map<string,bigint>>>")
    def run(words: pa.Array) -> pa.Array:
        d, out = sent.value, []
        for begin, end, types, (terms, row, term, occ, entry) in _row_hits(d, words):
            n = end - begin
            cell = row * width + d.category[entry]
            amount = np.where(d.prefix[entry] | (not legacy), occ, 1) * d.weight[entry]
            counts = np.zeros(n * width, np.int64)
            np.add.at(counts, cell, amount)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)
            maps = pa.nulls(n * width, pa.map_(pa.string(), pa.int64()))
            if with_detected:  # each term once in a cell, by name
                rank = np.empty(len(terms), np.int64)
                rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
                _, one = np.unique(cell * max(1, len(terms)) + rank[term], return_index=True)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(cell[one], minlength=n * width))])
                maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), terms.take(pa.array(term[one])), pa.array(occ[one], pa.int64()))
            out.append(pa.StructArray.from_arrays([pa.array(types, pa.int64()), lists(pa.array(counts)), lists(maps)], ["types", "counts", "detected"]))
        return pa.concat_arrays(out) if out else pa.nulls(0, pa.struct([("types", pa.int64()), ("counts", pa.list_(pa.int64())), ("detected", pa.list_(pa.map_(pa.string(), pa.int64())))]))

    return run(words)


def _listed(words: Column, sent, cats: list[str]) -> Column:
    """A row's hits: ``array<struct<category, term, occ, weight, match_kind>>``."""

    @F.arrow_udf("array<struct<category:string,term:string,occ:bigint,weight:bigint,match_kind:string>>")
    def run(words: pa.Array) -> pa.Array:
        d, out = sent.value, []
        names, kinds = pa.array(cats, pa.string()), pa.array(["exact", "prefix"])
        for begin, end, _, (terms, row, term, occ, entry) in _row_hits(d, words):
            take = lambda values, at: values.take(pa.array(at, pa.int64()))
            cells = [take(names, d.category[entry]), take(terms, term), pa.array(occ, pa.int64()), pa.array(d.weight[entry], pa.int64()), take(kinds, d.prefix[entry].astype(np.int64))]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - begin))])
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, ["category", "term", "occ", "weight", "match_kind"])))
        return pa.concat_arrays(out) if out else pa.nulls(0, pa.list_(pa.struct([("category", pa.string()), ("term", pa.string()), ("occ", pa.int64()), ("weight", pa.int64()), ("match_kind", pa.string())])))

    return run(words)


def stage_rows(df: DataFrame, text_col: str, orders: list[int], columns: list[str], start_filters: dict | None = None) -> DataFrame:
    """``columns`` + internal row id, token counts and the term bag
    ``array<struct<is_multi, term, occ>>``, written once and read back.

    ``start_filters`` (order -> first-token predicate) prunes n-grams that no
    multi-word entry can match; without it every n-gram of every order is kept.
    """
    df = balance(df)
    kept = [F.col(f"`{c}`") for c in columns]
    tk = F.col("__tk")
    base = df.select(*kept, F.monotonically_increasing_id().alias(ROW_ID), tokenize(text_column_of(df, text_col)).alias("__tk"))
    counts = [ROW_ID, TOKENS, TYPES]
    out = with_run_length(base, tk, "__u", [*columns, ROW_ID, "__tk"]).select(
        *kept, ROW_ID, "__tk", "__u",
        F.size(tk).cast("bigint").alias(TOKENS),
        F.size("__u").cast("bigint").alias(TYPES),
    )

    def pairs(name: str, multi: bool):
        return F.transform(F.col(name), lambda p: F.struct(F.lit(multi).alias("is_multi"), p["term"].alias("term"), p["occ"].alias("occ")))

    bag = pairs("__u", False)
    if orders:
        if start_filters:
            parts = [ngrams(tk, n, start_filters.get(n)) for n in orders]
            grams = parts[0] if len(parts) == 1 else F.concat(*parts)
        else:
            grams = all_ngrams(tk, orders)
        out = with_run_length(out, grams, "__m", [*columns, *counts, "__u"])
        bag = F.concat(bag, pairs("__m", True))
    return stage_table(out.select(*kept, *counts, bag.alias(BAG)), "bag")


def _multi_start_filters(v: DataFrame, orders: list[int]) -> dict | None:
    """First-token filters per n-gram order from the multi-word entries, if at most
    ``PRUNE_LIMIT`` of them exist (one bounded collect); else ``None`` (no pruning)."""
    if not orders:
        return None
    from termlens.operators.analyze import _start_filter
    from termlens.operators.vocabulary import LiteralVocabulary

    rows = v.filter(F.col("is_multi")).select("match_kind", "key").limit(PRUNE_LIMIT + 1).collect()
    if len(rows) > PRUNE_LIMIT:
        return None
    # one-word prefixes ("new *") are tested on the first token once per distinct
    # length; with many lengths the test costs more than building the n-gram
    one_word_lens = {len(r["key"]) for r in rows if r["match_kind"] == "prefix" and len(r["key"].split()) == 1}
    if len(one_word_lens) > MAX_PRUNE_PREFIX_LENGTHS:
        return None
    entries: dict = {"*": {True: {"exact": {}, "prefix": {}}}}
    for r in rows:
        entries["*"][True][r["match_kind"]][r["key"]] = 1
    lv = LiteralVocabulary(("*",), entries)
    return {n: _start_filter(lv, n) for n in orders}


def estimated_bytes(small: DataFrame, string_cols: list[str]) -> int:
    """Measured size bound of a small side: rows x fixed overhead + string bytes (one aggregate)."""
    row = small.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)).alias(f"l{i}") for i, c in enumerate(string_cols)],
    ).collect()[0]
    return int(row["n"]) * 64 + sum(int(row[f"l{i}"]) for i in range(len(string_cols)))


def _first_token(c):
    return F.substring_index(c, " ", 1)


def _with_prefixes(values: DataFrame, value: str, entries: DataFrame, group) -> DataFrame:
    """``values`` joined to the prefix ``entries`` that start them, by equi-joins only.

    ``group`` maps a value or key to what both must share in full (first character, first token):
    the lengths of a group's keys say which prefixes of a value to look up.
    """
    lengths = entries.groupBy(group(F.col("key")).alias("__g")).agg(F.collect_set("key_len").alias("__ls"))
    probes = explode_rows(
        values.withColumn("__g", group(F.col(value))).join(lengths, "__g"), values.columns, F.col("__ls"), "__l"
    ).filter(F.col("__l") <= F.length(value))
    probes = probes.withColumn("key", F.expr(f"substring(`{value}`, 1, __l)")).drop("__l")
    return probes.join(entries.select("key", "category", "weight", "match_kind"), "key").drop("key")


def match_terms(terms: DataFrame, v: DataFrame) -> DataFrame:
    """Distinct corpus terms ``(is_multi, term, n)`` -> one row per matching entry:
    ``is_multi, term, n, category, weight, match_kind``."""
    names = ["is_multi", "term", "n", "category", "weight", "match_kind"]
    exact = terms.join(
        v.filter(F.col("match_kind") == "exact").select("is_multi", F.col("key").alias("term"), "category", "weight", "match_kind"),
        ["is_multi", "term"],
    )
    prefix = v.filter(F.col("match_kind") == "prefix")
    words = _with_prefixes(terms.filter(~F.col("is_multi")), "term", prefix.filter(~F.col("is_multi")), lambda c: F.substring(c, 1, 1))
    grams = terms.filter(F.col("is_multi"))
    phrases = prefix.filter(F.col("is_multi"))
    # a one-word prefix has no space, so it starts the n-gram exactly when it starts the first token
    firsts = grams.select(_first_token(F.col("term")).alias("__first")).distinct()
    openers = _with_prefixes(firsts, "__first", phrases.filter(F.col("n_words") == 1), lambda c: F.substring(c, 1, 1))
    opened = grams.withColumn("__first", _first_token(F.col("term"))).join(openers, "__first")
    longer = _with_prefixes(grams, "term", phrases.filter(F.col("n_words") > 1), _first_token)
    return exact.select(names).unionByName(words.select(names)).unionByName(opened.select(names)).unionByName(longer.select(names))


def _occurrences(staged: DataFrame, keep: list[str]) -> DataFrame:
    """The staged bags as rows: ``keep`` + ``is_multi, term, occ``."""
    cols = [F.col(f"`{c}`") for c in keep]
    return explode_rows(staged, cols, F.col(BAG), "__p").select(*cols, "__p.is_multi", "__p.term", "__p.occ")


def _matched(staged: DataFrame, v: DataFrame) -> DataFrame:
    # written once: the branches of the match filter it differently and would each count it anew
    terms = _occurrences(staged, []).groupBy("is_multi", "term").agg(F.count(F.lit(1)).alias("n"))
    return match_terms(stage_table(terms, "terms"), v)


def _hits(staged: DataFrame, matched: DataFrame, keep: list[str], broadcast_limit_bytes: int) -> DataFrame:
    """The bag rows with the matched terms; ``matched`` is a written table."""
    keys = ["is_multi", "term"]
    bag = _occurrences(staged, keep)
    side = matched.drop("n")
    if estimated_bytes(matched, ["term", "category"]) <= broadcast_limit_bytes:
        return bag.join(F.broadcast(side), keys)
    parts = int(matched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = staged.agg(F.sum(F.size(BAG)).alias("n")).collect()[0]["n"] or 0
    is_hot = F.col("n") > F.lit(total / parts)  # at most ``parts`` terms can be
    hot = F.broadcast(matched.filter(is_hot).drop("n"))
    hot_terms = F.broadcast(matched.filter(is_hot).select(keys).distinct())
    frequent = bag.join(hot, keys)
    others = bag.join(hot_terms, keys, "left_anti").join(side, keys)
    return frequent.unionByName(others)


def _looked_up(bag: Column, per_term: DataFrame, cats: list[str], convention: str, with_detected: bool) -> Column:
    """The counts of every category (in the order of ``cats``) for a row's bag, and its detected terms:
    ``struct<counts: array<bigint>, detected: array<map<string,bigint>>>``.

    ``per_term`` (term, category, e, m) is a written table of checked size; it is sent to all tasks.
    """
    table = per_term.select("term", "category", "e", "m").toArrow().combine_chunks().sort_by("term")
    place = {c: i for i, c in enumerate(cats)}
    terms = pa.concat_arrays([c.cast(pa.string()) for c in table.column("term").chunks] or [pa.array([], pa.string())]).dictionary_encode()
    number = terms.indices.to_numpy()
    columns = [np.array([place[c] for c in table.column("category").to_pylist()], np.int64), table.column("e").to_numpy(), table.column("m").to_numpy()]
    # the matches of term i are the rows first[i]:first[i + 1]
    first = np.searchsorted(number, np.arange(len(terms.dictionary) + 1))
    sent = per_term.sparkSession.sparkContext.broadcast((terms.dictionary, first, *columns))
    width, legacy = len(cats), convention != "tokens"

    @F.arrow_udf("struct<counts:array<bigint>,detected:array<map<string,bigint>>>")
    def run(bags: pa.Array) -> pa.Array:
        n = len(bags)
        counts = np.zeros(n * width, np.int64)
        _, terms, occurrences = bags.flatten().flatten()
        terms = terms.dictionary_encode()
        code = terms.indices.to_numpy()
        size = np.diff(bags.offsets.to_numpy())
        matched, ends, cat, exact, prefix = sent.value
        row = pc.fill_null(pc.index_in(terms.dictionary, value_set=matched), -1).to_numpy()
        hits = np.where(row >= 0, ends[row + 1] - ends[row], 0)
        first = ends[row]
        # each entry of a bag, once for every match of its term
        times = hits[code]
        entry = np.repeat(np.arange(len(code)), times)
        match = np.repeat(first[code] - np.cumsum(times) + times, times) + np.arange(len(entry))
        occ = occurrences.to_numpy()[entry]
        cell = np.repeat(np.arange(n), size)[entry] * width + cat[match]
        np.add.at(counts, cell, (exact[match] if legacy else occ * exact[match]) + occ * prefix[match])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), values)
        maps = pa.nulls(n * width, pa.map_(pa.string(), pa.int64()))
        if with_detected:
            order = np.lexsort((row[code[entry]], cell))  # matched terms are sorted
            offsets = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=n * width))])
            maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), terms.dictionary.take(pa.array(code[entry][order])), pa.array(occ[order], pa.int64()))
        return pa.StructArray.from_arrays([lists(pa.array(counts)), lists(maps)], ["counts", "detected"])

    return run(bag)


def term_matches(
    df: DataFrame,
    key_col: str,
    text_col: str,
    vocab: Vocabulary,
    max_n: int = 3,
    broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Long-form hits ``(key, category, term, occ, weight, match_kind)``, per row and entry.

    ``key_col`` is only carried along: rows with null or equal keys each give their own hits.
    """
    v = vocab.staged()
    orders = needed_orders(None, max_n, v)
    if estimated_bytes(v, ["key", "category"]) <= broadcast_limit_bytes:
        cats = checked_categories(v)
        staged = stage_tokens(df, text_col, [key_col]).withColumnRenamed(key_col, ROW_KEY)
        hits = staged.select(ROW_KEY, _listed(F.col(WORDS), _sent(v, cats, orders), cats).alias("__hits"))
        return explode_rows(hits, [F.col(ROW_KEY).alias(key_col)], F.col("__hits"), "__h").select(
            key_col, *[F.col(f"__h.{c}").alias(c) for c in ("category", "term", "occ", "weight", "match_kind")]
        )
    staged = stage_rows(df, text_col, orders, [key_col], _multi_start_filters(v, orders)).withColumnRenamed(key_col, ROW_KEY)
    matched = stage_table(_matched(staged, v), "matched")
    return _hits(staged, matched, [ROW_KEY], broadcast_limit_bytes).select(
        F.col(ROW_KEY).alias(key_col), "category", "term", "occ", "weight", "match_kind"
    )


def _looked_up_columns(originals: list[str], names: dict[str, str], n_tok: Column, n_types: Column, cats: list[str], with_detected: bool) -> list[Column]:
    """The analysis columns of rows whose counts are in ``__res``."""
    from termlens.operators.analyze import COUNT_SUFFIX, DETECTED_SUFFIX, N_TOKENS, N_TYPES, PERC_SUFFIX

    out = [F.col(f"`{c}`") for c in originals]
    out += [n_tok.alias(names[N_TOKENS]), n_types.alias(names[N_TYPES])]
    for i, c in enumerate(cats):
        count = F.get(F.col("__res.counts"), F.lit(i))
        out.append(count.alias(names[f"{c}{COUNT_SUFFIX}"]))
        out.append(word_share(count, n_tok).alias(names[f"{c}{PERC_SUFFIX}"]))
        if with_detected:
            out.append(F.get(F.col("__res.detected"), F.lit(i)).alias(names[f"{c}{DETECTED_SUFFIX}"]))
    return out


def analyze_by_join(
    df: DataFrame,
    text_col: str,
    vocab: Vocabulary,
    key_col: str | None = None,
    max_n: int = 3,
    convention: str = "tokens",
    with_detected: bool = True,
    keep_columns: bool = True,
    broadcast_limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Same rows as the row-local plan, from one staged pass over the texts.

    A row's hits are bounded by its own length, so no group is unbounded.
    """
    from termlens.operators.analyze import COUNT_SUFFIX, DETECTED_SUFFIX, N_TOKENS, N_TYPES, PERC_SUFFIX, _output_names

    # declared categories keep their columns even without a usable entry
    cats = list(vocab.categories) or checked_categories(vocab.table)
    originals = list(df.columns) if keep_columns else ([key_col] if key_col else [])
    v = vocab.staged()
    orders = needed_orders(None, max_n, v)
    names = _output_names(originals, cats)
    if estimated_bytes(v, ["key", "category"]) <= broadcast_limit_bytes:
        rows = stage_tokens(df, text_col, originals)
        rows = rows.withColumn("__res", _counted(F.col(WORDS), _sent(v, cats, orders), len(cats), convention, with_detected))
        n_tok = F.size(WORDS).cast("bigint")
        return rows.select(*_looked_up_columns(originals, names, n_tok, F.col("__res.types"), cats, with_detected))
    staged = stage_rows(df, text_col, orders, originals, _multi_start_filters(v, orders))
    amount = lambda kind: F.coalesce(F.sum(F.when(F.col("match_kind") == kind, F.col("weight"))), F.lit(0)).cast("bigint")
    per_term = _matched(staged, v).groupBy("is_multi", "term", "n", "category").agg(amount("exact").alias("e"), amount("prefix").alias("m"))
    per_term = stage_table(per_term, "matched")
    n_tok = F.col(TOKENS)
    out = [F.col(f"`{c}`") for c in originals]
    out += [n_tok.alias(names[N_TOKENS]), F.col(TYPES).alias(names[N_TYPES])]
    if estimated_bytes(per_term, ["term", "category"]) <= broadcast_limit_bytes:
        rows = staged.withColumn("__res", _looked_up(F.col(BAG), per_term, cats, convention, with_detected))
        return rows.select(*_looked_up_columns(originals, names, n_tok, F.col(TYPES), cats, with_detected))
    hits = _hits(staged, per_term, [ROW_ID], broadcast_limit_bytes)
    # legacy: an exact entry counts the term once, a prefix entry its occurrences
    exact = F.col("occ") * F.col("e") if convention == "tokens" else F.col("e")
    aggs = [F.sum(exact + F.col("occ") * F.col("m")).cast("bigint").alias("cnt")]
    if with_detected:
        aggs.append(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "occ")))).alias("det"))
    else:
        aggs.append(F.lit(None).cast("map<string,bigint>").alias("det"))
    per_row = (
        hits.groupBy(ROW_ID, "category").agg(*aggs)
        .groupBy(ROW_ID).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("cnt", "det")))).alias("__res"))
    )
    joined = staged.drop(BAG).join(per_row, ROW_ID, "left")
    empty = F.create_map().cast("map<string,bigint>")
    for c in cats:
        r = F.col("__res")[F.lit(c)]
        cc = F.coalesce(r["cnt"], F.lit(0).cast("bigint"))
        out.append(cc.alias(names[f"{c}{COUNT_SUFFIX}"]))
        out.append(word_share(cc, n_tok).alias(names[f"{c}{PERC_SUFFIX}"]))
        if with_detected:
            out.append(F.coalesce(r["det"], empty).alias(names[f"{c}{DETECTED_SUFFIX}"]))
    return joined.select(*out)
