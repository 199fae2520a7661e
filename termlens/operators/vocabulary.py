"""Wordlist (wide ``DicTerm`` x category matrix) -> long vocabulary table, as DataFrame ops.

Vocabulary table (one row per distinct matching entry)::

    namespace STRING, category STRING, category_pos INT,
    match_kind STRING ('exact' | 'prefix'), is_multi BOOLEAN,
    key STRING, key_len INT, n_words INT, weight BIGINT,
    first_place STRUCT<path STRING, start BIGINT, nth BIGINT>

``weight`` is 1 for an exact entry (a category's exact terms are a set) and
the number of duplicate rows for a prefix entry (a category's wildcard
entries are a bag, so a repeated ``happ*`` doubles the count).
``first_place`` is where an entry first stands in the files that a wordlist
was read from (null for a frame, which has no order).

The vocabulary stays a DataFrame end to end.  Only small, explicitly
size-checked facts reach the driver: the category list (needed because the
wide output schema depends on it) and, for the row-local plan, the entries
themselves when they are below the literal threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import (
    MissingDicTermColumnError,
    NoCategoryColumnsError,
    UnknownCategoryError,
)
from termlens.functions.naming import allot, sanitize_columns, sanitize_identifier
from termlens.functions.text import WHITE, strip
from termlens.session import stage_table

# The term column is named "DicTerm"; a cell is active when it
# equals "X" after trimming, case-insensitively; a trailing "*" marks a prefix.
DICTERM = "DicTerm"
ORDINAL = "__tl_ordinal"  # the place of a row in its files, added by read_wordlist
ACTIVE_CELL = "X"
WILDCARD = "*"

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("category_pos", T.IntegerType()),
        T.StructField("match_kind", T.StringType()),
        T.StructField("is_multi", T.BooleanType()),
        T.StructField("key", T.StringType()),
        T.StructField("key_len", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("weight", T.LongType()),
        T.StructField("first_place", T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType()), T.StructField("nth", T.LongType())])),
    ]
)


def _n_words(c):
    return F.size(F.split(strip(c), WHITE))


def category_columns(wordlist: DataFrame) -> list[str]:
    """Validate the wordlist layout and return its raw category column names (file order)."""
    cols = wordlist.columns
    if DICTERM not in cols:
        raise MissingDicTermColumnError(f"the wordlist must contain a '{DICTERM}' column; got {cols}")
    cats = [c for c in cols if c not in (DICTERM, ORDINAL)]
    if not cats:
        raise NoCategoryColumnsError(f"the wordlist has no category columns (only '{DICTERM}')")
    return cats


def wordlist_entries(wordlist: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Unpivot + normalise: ``(category, is_multi, is_prefix, key, place)`` per active cell (bag).

    The term column is selected **by name**, whatever its position.  ``names``
    gives the output category names (default: sanitised + uniquified raw names).
    """
    raw = category_columns(wordlist)
    names = list(names) if names is not None else sanitize_columns(raw)
    place = F.col(ORDINAL) if ORDINAL in wordlist.columns else F.lit(None)
    renamed = wordlist.select(
        place.cast(VOCAB_SCHEMA["first_place"].dataType).alias("place"),
        F.col(f"`{DICTERM}`").cast("string").alias("__term"),
        *[F.col(f"`{c}`").cast("string").alias(f"__c{i}") for i, c in enumerate(raw)],
    )
    # unpivot with literal category names: (term, category, cell)
    stacked = renamed.select(
        "place",
        "__term",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"__c{i}").alias("cell")) for i, n in enumerate(names)])
        ).alias("__e"),
    ).select("place", "__term", F.col("__e.category").alias("category"), F.col("__e.cell").alias("cell"))
    term = F.lower(strip(F.col("__term")))
    active = stacked.filter(F.upper(strip(F.col("cell"))) == ACTIVE_CELL).select(
        "category", "place", term.alias("term")
    )
    active = active.filter(F.col("term").isNotNull() & (F.col("term") != ""))
    is_prefix = F.col("term").endswith(WILDCARD)
    key = F.when(is_prefix, strip(F.expr("substring(term, 1, length(term) - 1)"))).otherwise(F.col("term"))
    return (
        active.select(
            "category",
            # single/multi is decided on the term *with* its star: "new *" is multi.
            (_n_words(F.col("term")) > 1).alias("is_multi"),
            is_prefix.alias("is_prefix"),
            key.alias("key"),
            "place",
        )
        .filter(F.col("key") != "")
    )


def _to_vocab(entries: DataFrame, namespace: str, positions: Mapping[str, int]) -> DataFrame:
    """Bag of entries -> vocabulary rows (exact deduped, prefix counted)."""
    grouped = entries.groupBy("category", "is_multi", "is_prefix", "key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    pos_map = F.create_map(*[x for k, v in positions.items() for x in (F.lit(k), F.lit(v))]) if positions else None
    return grouped.select(
        F.lit(namespace).alias("namespace"),
        F.col("category"),
        (pos_map[F.col("category")] if pos_map is not None else F.lit(None)).cast("int").alias("category_pos"),
        F.when(F.col("is_prefix"), F.lit("prefix")).otherwise(F.lit("exact")).alias("match_kind"),
        F.col("is_multi"),
        F.col("key"),
        F.length("key").cast("int").alias("key_len"),
        _n_words(F.col("key")).cast("int").alias("n_words"),
        F.when(F.col("is_prefix"), F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("weight"),
        F.col("place").alias("first_place"),
    )


@dataclass
class Vocabulary:
    """A vocabulary table plus its (small) ordered category list."""

    table: DataFrame
    categories: list[str] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)  # of each category, also of one without entries

    # -- accessors (VOC-13) -------------------------------------------------
    @property
    def n_categories(self) -> int:
        return len(self.categories)

    def staged(self) -> DataFrame:
        """The table written once under the shared checkpoint folder: several small jobs read it."""
        if "_staged" not in self.__dict__:
            self.__dict__["_staged"] = stage_table(self.table, "vocabulary")
        return self.__dict__["_staged"]

    def terms_for(self, category: str) -> DataFrame:
        if category not in self.categories:
            raise UnknownCategoryError(f"unknown category {category!r}; known: {self.categories}")
        return self.table.filter(F.col("category") == category)

    def select(self, names: Sequence[str] | None) -> Vocabulary:
        """Keep the named categories (VOC-9). ``None``/empty keeps all; unknown names are
        ignored unless none matches, which is an error."""
        if not names:
            return self
        keep = [c for c in self.categories if c in set(names)]
        if not keep:
            raise UnknownCategoryError(f"none of the categories {list(names)} exists; known: {self.categories}")
        return Vocabulary(self.table.filter(F.col("category").isin(keep)), keep, self.namespaces)

    def union(self, other: Vocabulary) -> Vocabulary:
        """Bag union; a category present in both adds up (same name = same column)."""
        cats = list(dict.fromkeys([*self.categories, *other.categories]))
        pos = {c: i for i, c in enumerate(cats)}
        table = self.table.unionByName(other.table).withColumn(
            "category_pos", F.create_map(*[x for k, v in pos.items() for x in (F.lit(k), F.lit(v))])[F.col("category")]
        )
        return Vocabulary(table, cats, {**other.namespaces, **self.namespaces})

    def category_table(self) -> DataFrame:
        """``(namespace, category, category_pos)`` of every category, with or without entries."""
        rows = [(self.namespaces.get(c, ""), c, i) for i, c in enumerate(self.categories)]
        return self.table.sparkSession.createDataFrame(rows, "namespace string, category string, category_pos int")


def vocabulary_from_wordlist(wordlist: DataFrame, namespace: str | None = None, qualify: bool = False) -> Vocabulary:
    """One wordlist -> :class:`Vocabulary`. Categories are sorted by name (VOC-8).

    With ``qualify`` the categories are named ``{namespace}_{category}`` (as
    :func:`merge_wordlists` does); otherwise the sanitised column names are used.
    """
    raw = category_columns(wordlist)
    names = sanitize_columns(raw)
    ns = sanitize_identifier(namespace) if namespace else ""
    final = [sanitize_identifier(f"{ns}_{n}") for n in names] if qualify else names
    if qualify:
        final = allot(final)
    entries = wordlist_entries(wordlist, final)
    ordered = sorted(final)
    return Vocabulary(_to_vocab(entries, ns, {c: i for i, c in enumerate(ordered)}), ordered, dict.fromkeys(ordered, ns))


def merge_wordlists(
    wordlists: Sequence[tuple[DataFrame, str]],
    prefixes: Sequence[str | None] | Mapping[str, str] | None = None,
) -> Vocabulary:
    """Several wordlists -> one namespaced vocabulary (VOC-7).

    ``wordlists`` holds ``(frame, file_name)`` pairs; the namespace is the
    sanitised prefix, or the file stem when the prefix is missing/empty.
    ``prefixes`` is a list (padded with ``None``) or a mapping keyed by file
    name.  Category ``{namespace}_{category}`` is uniquified over all files, in
    file column order, before each list's categories are sorted.
    """
    given = prefixes if isinstance(prefixes, Mapping) else dict(enumerate(prefixes or []))
    # one row per category column: (file, wanted name); names are allotted over all files at once
    spaces, wanted = [], []
    for i, (frame, name) in enumerate(wordlists):
        prefix = given.get(_basename(name)) if isinstance(prefixes, Mapping) else given.get(i)
        spaces.append(sanitize_identifier(prefix or _stem(name)))
        wanted += [(i, sanitize_identifier(f"{spaces[i]}_{c}")) for c in sanitize_columns(category_columns(frame))]
    named = list(zip((i for i, _ in wanted), allot(n for _, n in wanted)))
    order = [n for _, n in sorted(named)]
    place = {n: at for at, n in enumerate(order)}
    tables = [
        _to_vocab(wordlist_entries(frame, [n for j, n in named if j == i]), spaces[i], place)
        for i, (frame, _) in enumerate(wordlists)
    ]
    if not tables:
        some = vocabulary_from_entries(SparkSession.active(), {"none": ["none"]})
        return Vocabulary(some.table.limit(0), [])
    return Vocabulary(reduce(DataFrame.unionByName, tables), order, {n: spaces[i] for i, n in named})


def _basename(name: str) -> str:
    return name.replace("\\", "/").rsplit("/", 1)[-1]


def _stem(name: str) -> str:
    base = _basename(name or "")
    return base.rsplit(".", 1)[0] if "." in base[1:] else base


def vocabulary_from_entries(spark: SparkSession, entries: Mapping[str, Sequence[str]], namespace: str = "") -> Vocabulary:
    """Convenience: ``{category: [terms...]}`` with ``*`` wildcards -> Vocabulary.

    Built through the same wide-matrix path as files (one ``X`` column per
    category), so the term rules are identical.
    """
    cats = list(entries)
    rows = []
    for ci, cat in enumerate(cats):
        for term in entries[cat]:
            rows.append(tuple([term] + ["X" if j == ci else None for j in range(len(cats))]))
    schema = T.StructType([T.StructField(DICTERM, T.StringType())] + [T.StructField(c, T.StringType()) for c in cats])
    wide = spark.createDataFrame(rows, schema)
    return vocabulary_from_wordlist(wide, namespace or None, qualify=bool(namespace))


# --------------------------------------------------------------------------- #
# Driver-side, size-checked views
# --------------------------------------------------------------------------- #
@dataclass(frozen=True)
class LiteralVocabulary:
    """Entries collected for the row-local plan; only built below a checked size."""

    categories: tuple[str, ...]
    # category -> is_multi -> kind -> {key: weight}
    entries: dict

    def keys(self, category: str | None, is_multi: bool, kind: str) -> dict[str, int]:
        cats = self.categories if category is None else (category,)
        out: dict[str, int] = {}
        for c in cats:
            for k, w in self.entries.get(c, {}).get(is_multi, {}).get(kind, {}).items():
                out[k] = out.get(k, 0) + w
        return out


def collect_literal_vocabulary(vocab: Vocabulary, max_entries: int) -> LiteralVocabulary | None:
    """Collect the entries if there are at most ``max_entries`` of them, else ``None``.

    One bounded job: at most ``max_entries + 1`` rows ever reach the driver,
    so an oversized vocabulary is detected without being collected.
    """
    cache = vocab.__dict__.setdefault("_literal_cache", {})
    if max_entries in cache:
        return cache[max_entries]
    rows = vocab.table.select("category", "is_multi", "match_kind", "key", "weight").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        cache[max_entries] = None
        return None
    entries: dict = {}
    for r in rows:
        slot = entries.setdefault(r["category"], {}).setdefault(bool(r["is_multi"]), {}).setdefault(r["match_kind"], {})
        slot[r["key"]] = slot.get(r["key"], 0) + int(r["weight"])
    cache[max_entries] = LiteralVocabulary(tuple(vocab.categories), entries)
    return cache[max_entries]


def checked_categories(vocab_table: DataFrame) -> list[str]:
    """Ordered distinct categories of a vocabulary table (first position wins).

    Only names reach the driver, as the wide output has columns named after them; with very many
    categories prefer the long rows of :func:`termlens.operators.matches.term_matches`.
    """
    rows = vocab_table.groupBy("category").agg(F.min("category_pos").alias("p")).orderBy("p", "category").collect()
    return [r["category"] for r in rows]


# --------------------------------------------------------------------------- #
# Summaries
# --------------------------------------------------------------------------- #
def _bounded_lists(rows: DataFrame, order: list[str], sizes: dict[str, tuple[bool, int]]) -> DataFrame:
    """Per category and per name in ``sizes``: the first (or, with True, last) n terms in ``order``,
    as an ordered array.  Each is a top-k window with a per-partition group limit, so a huge category
    is never sorted in one task."""
    out = None
    for name, (last, n) in sizes.items():
        w = Window.partitionBy("category").orderBy(*[F.col(c).desc() if last else F.col(c).asc() for c in order])
        top = rows.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
        items = F.array_sort(F.collect_list(F.struct(*order)))
        one = top.groupBy("category").agg(F.transform(items, lambda x: x[order[-1]]).alias(name))
        out = one if out is None else out.join(one, "category", "full")
    return out


def vocabulary_summary(vocab: Vocabulary, sample: int = 10) -> DataFrame:
    """Per category, with or without entries: n_terms (prefix duplicates counted) and up to
    ``sample`` example terms (VOC-11).

    Sample order: exact single sorted, exact multi sorted, then prefix single
    and prefix multi with ``*`` re-attached, each once, in the order of the files (sorted where the
    wordlist is a frame).
    The vocabulary is staged once; a category without entries has 0 terms and an empty sample.
    """
    rank = (
        F.when((F.col("match_kind") == "exact") & ~F.col("is_multi"), 0)
        .when((F.col("match_kind") == "exact") & F.col("is_multi"), 1)
        .when(~F.col("is_multi"), 2)
        .otherwise(3)
    )
    shown = F.when(F.col("match_kind") == "prefix", F.concat(F.col("key"), F.lit(WILDCARD))).otherwise(F.col("key"))
    place = F.when(F.col("match_kind") == "prefix", F.col("first_place"))
    t = vocab.staged().select("category", "weight", rank.alias("r"), place.alias("place"), shown.alias("term"))
    totals = t.groupBy("category").agg(F.sum("weight").cast("bigint").alias("n"))
    samples = _bounded_lists(t, ["r", "place", "term"], {"some": (False, sample)})
    return vocab.category_table().join(totals, "category", "left").join(samples, "category", "left").select(
        "namespace",
        "category",
        "category_pos",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_terms"),
        F.coalesce(F.array_join("some", ", "), F.lit("")).alias("sample_terms"),
    )


def vocabulary_head_tail(vocab: Vocabulary) -> DataFrame:
    """Legacy text summary per category (VOC-12): exact terms sorted (single, then multi);
    all of them if at most 6, else first 3 + ``...`` + last 3; ``None`` if there are none."""
    exact = vocab.staged().filter(F.col("match_kind") == "exact").select("category", F.col("is_multi").cast("int").alias("m"), "key")
    counts = exact.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    edges = _bounded_lists(exact, ["m", "key"], {"head": (False, 6), "tail": (True, 3)})
    j = vocab.category_table().join(counts, "category", "left").join(edges, "category", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    words = (
        F.when(n == 0, F.lit("None"))
        .when(n <= 6, F.array_join("head", ", "))
        .otherwise(F.concat(F.array_join(F.slice("head", 1, 3), ", "), F.lit(", ... , "), F.array_join("tail", ", ")))
    )
    return j.select(
        "category",
        "category_pos",
        n.cast("bigint").alias("n_terms"),
        F.concat(F.lit("**"), F.col("category"), F.lit(" ("), n.cast("string"), F.lit(" terms):** "), words, F.lit(";")).alias("summary"),
    )


def needed_orders(vocab_rows: LiteralVocabulary | None, max_n: int, table: DataFrame | None = None) -> list[int]:
    """n-gram orders any entry can match (VOC-14). Pure pruning: the result equals
    counting with every order ``2..max_n``."""
    if vocab_rows is not None:
        kinds = {
            (kind, len(entry.split()))
            for kind in ("exact", "prefix")
            for category in vocab_rows.categories
            for entry in vocab_rows.keys(category, True, kind)
        }
    else:
        assert table is not None
        found = table.filter(F.col("is_multi")).select("match_kind", "n_words").distinct().collect()
        kinds = {(r["match_kind"], int(r["n_words"])) for r in found}
    # an exact entry needs its own order; the shortest prefix needs every order from its own on
    exact = {n for kind, n in kinds if kind == "exact"}
    shortest = min((n for kind, n in kinds if kind == "prefix" and n >= 1), default=max_n + 1)
    return [n for n in range(2, max_n + 1) if n in exact or n >= shortest]
