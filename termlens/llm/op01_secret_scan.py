"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by its content (SHA-256).  The ledger is a table with one row
for each (blob, rule, rule version) that has been scanned, holding the spans found.  A scan takes
one text of each blob, tests only the rules whose pair is not in the ledger, adds those rows, and
joins the findings back to every path that holds the blob.

Spans are [start, end) in code points of the whole text.  Positions come from splitting the text by
the rule's pattern: match i begins after the lengths of the pieces and matches before it.

Defined results: a null text is empty text and has no spans; repeated rows and repeated ids each get
their blob's findings; spans that begin together are ordered by rule; texts of any length are scanned
whole; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.functions.text import let
from termlens.llm.common import keep, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlap; matches whose ``group`` is shorter than
    ``least`` characters are dropped.  ``hint`` must occur in every text with a kept match; it only
    saves time.  Raise ``version`` when a rule changes, and its pairs become unseen."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# The three base rules.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"(?i:(?:pass(?:word|wd)|secret|token|api_?key))[\x22\x27]?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
)

SPANS = "array<struct<start:int,end:int>>"
WALK = 256  # matches walked in one run
LEDGER = f"blob string, rule string, rule_version int, spans {SPANS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """The kept matches of one rule in ``text`` as an array of (start, end)."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), part.alias("part"))
    none = F.array().cast(SPANS)

    # walk the (gap, match) pairs, carrying the end of the last match; the pair after the last
    # match has a null hit
    def walk(some: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
                F.when(
                    F.length(x["part"]) >= rule.least,
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"))),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )

    # an array that grows is copied at every step, so runs of WALK pairs are walked on their own and
    # moved to where they begin
    runs = let(steps, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(WALK)), lambda i: walk(F.slice(all_, i, F.lit(WALK)))))
    joined = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")),
        lambda acc, run: F.struct(
            (acc["at"] + run["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(run["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"))))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(rule.hint), joined).otherwise(none)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """New ledger rows for the (blob, rule, version) pairs of ``versions`` that ``ledger`` lacks."""
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # one text of each blob; copies meet in the partial aggregate before the shuffle
    blobs = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    wanted = F.array(*[F.concat_ws("@", F.lit(r.name), F.lit(r.version)) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("unseen", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        blobs = blobs.withColumn("unseen", F.array_except(wanted, F.coalesce(F.col("seen"), F.array().cast("array<string>"))))
    body = F.col("body")
    found = [
        F.when(
            F.array_contains("unseen", f"{r.name}@{r.version}"),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), spans_of(body, r).alias("spans")),
        )
        for r in rules
    ]
    rows = blobs.select("blob", F.explode_outer(F.array_compact(F.array(*found))).alias("x"))
    return rows.where(F.col("x").isNotNull()).select("blob", "x.rule", "x.rule_version", "x.spans")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """One row per blob with spans: (blob, spans array of (start, rule number, rule, end), sorted)."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}@{r.version}"), F.lit(i))])
    tag = F.concat_ws("@", "rule", "rule_version")
    known = ledger.where((F.size("spans") > 0) & tag.isin([f"{r.name}@{r.version}" for r in rules]))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(number, tag).alias("number"), F.col("rule").alias("rule"), s["end"].alias("end")))
    # a blob has at most one row per rule, so the lists are short
    return known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def ledger_of(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """The ledger after scanning ``versions``: the old rows and the new ones, written once."""
    new = scan(versions, ledger, rules, text)
    return keep(new if ledger is None else ledger.unionByName(new), "ledger")


def attach(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Every row of ``versions`` with its blob's spans in column ``out`` (an empty array: none).

    The findings have one row per blob and only for blobs with secrets; both sides are shuffled by
    blob, so a blob that a third of all rows share is split by the adaptive skew join.
    """
    key = f"__blob_{out}"
    found = findings(ledger, rules)
    found = keep(found, "findings").select(F.col("blob").alias(key), F.col("spans").alias(out))
    rows = versions.withColumn(key, blob_of(versions[text])).join(found, key, "left").drop(key)
    return rows.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<struct<start:int,number:int,rule:string,end:int>>")))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark``; same columns."""
    spans = "__secret_spans"
    rows = attach(docs, ledger_of(docs, None, rules, text), rules, text, spans)
    body = rows[text]
    done = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)),
    )
    clean = F.when(F.size(spans) > 0, done).otherwise(body)
    return rows.withColumn(text, clean).drop(spans)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the base rules in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = attach(docs, ledger_of(docs)).drop("text")
    joined = F.array_join(F.transform("secret_spans", lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    count = lambda name: F.size(F.filter("secret_spans", lambda s: s["rule"] == name)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined, 256).alias("base_sha256"),
        joined.alias("spans"),
    )


# DuckDB: pieces between matches and the matches themselves give the positions, by one list per kind.
def _sql_kind(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, rid, '{kind}' AS kind, {number} AS num, s AS st, s + length(hit) AS en FROM (
      SELECT doc_id, rid, hit, part, i,
             list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, rid, text, hits, pieces, unnest(hits) AS hit, unnest(parts) AS part, generate_subscripts(hits, 1) AS i
            FROM (SELECT doc_id, rid, text, regexp_extract_all(text, '{pattern}') AS hits,
                         regexp_extract_all(text, '{pattern}', {group}) AS parts,
                         regexp_split_to_array(text, '{pattern}') AS pieces FROM d)))
    WHERE length(part) >= {least}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
f AS ({_sql_kind("assign", 0, _ASSIGN, 2, 12)}
  UNION ALL {_sql_kind("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
  UNION ALL {_sql_kind("hex", 2, "[0-9a-f]{16,}", 0, 16)}),
g AS (SELECT rid, count(*) FILTER (num = 0) AS a, count(*) FILTER (num = 1) AS k, count(*) FILTER (num = 2) AS h,
             string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, num) AS j FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
