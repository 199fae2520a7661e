"""DuckDB oracle SQL for every checkable registered query.

Written independently of the Spark plans: prefix entries are matched with
``starts_with`` over all n-gram orders ``2..max_n`` (no pruning, no
prefix-length rewrite), the dictionary rules are applied to literal entries
here, tail probabilities come from Simpson integration of the incomplete beta
integral, and t quantiles from a Cornish-Fisher start plus one Newton step.
"""

from __future__ import annotations

from termlens.plans.catalog import (
    CATEGORIES,
    EXACT_MULTI_WORDLIST,
    OVERLAP_WORDLIST,
    PREFIX_MULTI_WORDLIST,
    PREFIX_SINGLE_WORDLIST,
    TEST_WORDLIST,
)

TOKEN_SQL = r"'[\p{L}\p{N}_'']+'"
STEPS = 100_000  # Simpson panels (even)
# The columns of lineitem by what they serve as.
LINEITEM_ROLES = [(role, c) for role, names in (("text", ("l_returnflag", "l_linestatus")), ("numeric", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")), ("category", ("l_returnflag", "l_linestatus"))) for c in names]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _entries(wordlist: dict[str, list[str]]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for cat, terms in wordlist.items():
        for raw in terms:
            t = raw.strip().lower()
            if not t:
                continue
            kind = "m" if len(t.split()) > 1 else "s"
            if t.endswith("*"):
                k = t[:-1].strip()
                if k:
                    out[(cat, kind, "w", k)] = out.get((cat, kind, "w", k), 0) + 1
            else:
                out[(cat, kind, "e", t)] = 1
    return out


def _tk(table="documents", key="doc_id", text="text", extra: str = "") -> str:
    ex = f", {extra}" if extra else ""
    return f"t as (select {key} k{ex}, regexp_extract_all(lower(coalesce({text}, '')), {TOKEN_SQL}) tk from {table})"


def _grams(max_n: int) -> str:
    parts = ["select k, 's' m, unnest(tk) term from t"]
    for n in range(2, max_n + 1):
        parts.append(
            f"select k, 'm' m, unnest(list_transform(range(1, len(tk) - {n} + 2), lambda i: array_to_string(tk[i:i+{n - 1}], ' '))) term from t"
        )
    return "g as (" + " union all ".join(parts) + "),\no as (select k, m, term, count(*)::bigint occ from g group by all)"


def _match(wordlist: dict[str, list[str]], max_n: int = 3, convention: str = "tokens") -> str:
    vals = ", ".join(f"({_q(c)}, '{m}', '{k}', {_q(x)}, {w})" for (c, m, k, x), w in sorted(_entries(wordlist).items()))
    cnt = "sum(occ * (e + p))" if convention == "tokens" else "sum(e + occ * p)"
    return f"""{_grams(max_n)},
v(cat, m, kind, x, w) as (values {vals}),
h as (select o.k, v.cat, o.term, o.occ,
        sum(case when v.kind = 'e' then v.w else 0 end)::bigint e,
        sum(case when v.kind = 'w' then v.w else 0 end)::bigint p
      from o join v on o.m = v.m and ((v.kind = 'e' and o.term = v.x) or (v.kind = 'w' and starts_with(o.term, v.x)))
      group by all),
c as (select k, cat, {cnt}::bigint cnt, string_agg(term || ': ' || occ, ', ' order by term) det from h group by all)"""


def _wide_cols(cats, perc=True, counts=True, det=False, rnd=True) -> list[str]:
    cols = []
    for c in cats:
        cnt = f"coalesce(max(c.cnt) filter (where c.cat = {_q(c)}), 0)::bigint"
        if counts:
            cols.append(f"{cnt} {c}_word_count")
        if perc:
            e = f"case when len(t.tk) > 0 then {cnt} / len(t.tk) else 0.0 end"
            cols.append(f"round({e}, 6) {c}_word_perc" if rnd else f"{e} {c}_word_perc")
        if det:
            cols.append(f"coalesce(max(c.det) filter (where c.cat = {_q(c)}), '') {c}_detected_words")
    return cols


def _analysis_cte(wordlist=None, extra="lang, source", rnd=False, max_n=3, convention="tokens", det=False) -> str:
    """CTE ``an``: k, extra cols, n_tokens, n_types, per category count/perc(/det)."""
    wl = wordlist or TEST_WORDLIST
    cats = sorted(wl)
    ex = [x.strip() for x in extra.split(",") if x.strip()]
    cols = ["t.k"] + [f"t.{x}" for x in ex] + ["len(t.tk)::bigint n_tokens", "len(list_distinct(t.tk))::bigint n_types"]
    cols += _wide_cols(cats, rnd=rnd, det=det)
    grp = ", ".join(["t.k", "t.tk"] + [f"t.{x}" for x in ex])
    return f"""with {_tk(extra=extra)},
{_match(wl, max_n, convention)},
an as (select {', '.join(cols)} from t left join c on t.k = c.k group by {grp})"""


# --------------------------------------------------------------------------- #
# numeric helpers (Simpson integration of the incomplete beta)
# --------------------------------------------------------------------------- #
def _ibeta(src: str, a: str, b: str, x: str, keys: str) -> str:
    """SQL returning ``keys..., ib`` = I_x(a, b) for each row of ``src`` (needs a, b >= 1/2)."""
    n = STEPS
    return f"""(select {keys}, least(1.0, greatest(0.0,
        2.0 / exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))
        * (asin(sqrt({x})) / {n}) / 3.0
        * sum((case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end)
              * pow(sin(asin(sqrt({x})) * i / {n}), 2 * {a} - 1)
              * pow(cos(asin(sqrt({x})) * i / {n}), 2 * {b} - 1)))) ib
      from {src}, range(0, {n} + 1) r(i) group by {keys})"""


def _t_quantile_975(src: str, nu: str, keys: str) -> str:
    """t_{0.975}(nu) for each row: Cornish-Fisher start, one Newton step on the Simpson CDF."""
    z = "1.959963984540054::double"
    t0 = (
        f"({z} + ({z}^3 + {z}) / (4 * {nu}) + (5 * {z}^5 + 16 * {z}^3 + 3 * {z}) / (96 * {nu}^2)"
        f" + (3 * {z}^7 + 19 * {z}^5 + 17 * {z}^3 - 15 * {z}) / (384 * {nu}^3)"
        f" + (79 * {z}^9 + 776 * {z}^7 + 1482 * {z}^5 - 1920 * {z}^3 - 945 * {z}) / (92160 * {nu}^4))"
    )
    start = f"(select {keys}, {nu} nu, {t0} t0 from {src})"
    ib = _ibeta(start, "nu / 2.0", "0.5", "nu / (nu + t0 * t0)", f"{keys}, nu, t0")
    pdf = "exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0)) / sqrt(nu * pi()) * pow(1 + t0 * t0 / nu, -(nu + 1) / 2.0)"
    return f"(select {keys}, t0 - ((1 - 0.5 * ib) - 0.975) / ({pdf}) tq from {ib})"


def _pearson_sql(an_cte: str, pairs: list[tuple[str, str]], source: str = "an") -> str:
    sel = " union all ".join(
        f"select {_q(a)} col1, {_q(b)} col2, corr({b}, {a}) r, count(*) n from {source} where {a} is not null and {b} is not null and not isnan({a}::double) and not isnan({b}::double)"
        for a, b in pairs
    )
    return f"""{an_cte},
s as ({sel}),
pr as (select col1, col2, greatest(-1.0, least(1.0, r)) r, n from s),
pv as {_ibeta("pr", "((n - 2) / 2.0)", "0.5", "(1 - r * r)", "col1, col2, r, n")}
select col1, col2, round(r, 6) coefficient, round(case when n <= 2 then 1.0 when abs(r) >= 1 then 0.0 else ib end, 6) p_value, n::bigint n from pv"""


def _groups_sql(an_cte: str, cat: str, val: str, source: str = "an") -> str:
    return f"""{an_cte},
gp as (select {cat} grp, count(*)::bigint n, avg({val}::double) mean, var_samp({val}::double) var
      from {source} where {cat} is not null and {val} is not null and not isnan({val}::double) group by {cat})"""


def _ci_sql(an_cte: str, cat: str, val: str, z: bool = False, bars: bool = False, source: str = "an") -> str:
    base = _groups_sql(an_cte, cat, val, source) + ",\ngs as (select grp, n, mean, coalesce(sqrt(var / n), 0.0) sem from gp)"
    if z:
        half = "1.96 * sem"
        body = f"{base},\nci as (select grp, n, mean, sem, {half} half from gs)"
    else:
        tq = _t_quantile_975("(select * from gs where n >= 2 and sem <> 0)", "(n - 1)::double", "grp")
        body = f"{base},\ntq as {tq},\nci as (select gs.grp, n, mean, sem, coalesce(tq * sem, 0.0) half from gs left join tq on gs.grp = tq.grp)"
    if bars:
        return f"{body}\nselect grp::varchar category, round(mean, 6) mean, round(half, 6) err_plus, round(half, 6) err_minus from ci"
    return f"{body}\nselect grp::varchar category, n, round(mean, 6) mean, round(sem, 6) sem, round(mean - half, 6) ci_lower, round(mean + half, 6) ci_upper from ci"


def _anova_sql(an_cte: str, cat: str, val: str, source: str = "an") -> str:
    return f"""{_groups_sql(an_cte, cat, val, source)},
tot as (select sum(n) nn, count(*) kk, sum(n * mean) / sum(n) mm from gp),
s as (select sum(n * (mean - mm) * (mean - mm)) ssb, sum(coalesce((n - 1) * var, 0.0)) ssw, (kk - 1)::double df_b, (nn - kk)::double df_w from gp, tot group by kk, nn),
f as (select *, (ssb / df_b) / (ssw / df_w) fstat from s),
pv as {_ibeta("f", "(df_w / 2.0)", "(df_b / 2.0)", "(df_w / (df_w + df_b * fstat))", "ssb, ssw, df_b, df_w, fstat")}
select 'C({cat})' source, round(ssb, 6) sum_sq, round(df_b, 6) df, round(fstat, 6) "F", round(ib, 6) "PR(>F)" from pv
union all select 'Residual', round(ssw, 6), round(df_w, 6), null::double, null::double from pv"""


# --------------------------------------------------------------------------- #
# table-derived wordlist (benchmark)
# --------------------------------------------------------------------------- #
BENCH_WIDE = r"""words as (select distinct unnest(regexp_extract_all(text, '\p{L}+')) w from benchmark),
pairs as (select unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) p,
                 unnest(list_transform(range(1, len(ws)), lambda i: ws[i])) first
          from (select regexp_extract_all(text, '\p{L}+') ws from benchmark)),
wide as (
  select w "DicTerm", case when length(w) <= 3 then 'X' end short, case when length(w) between 4 and 6 then ' x ' end medium,
         case when length(w) >= 7 then 'X' end long, null::varchar phrase from words
  union all select substring(w, 1, 4) || '*', null, null, 'X', null from words where length(w) >= 7
  union all select p, null, null, null, ' x ' from (select distinct p from pairs)
  union all select f || ' *', null, null, null, 'X' from (select distinct first f from pairs)
)"""


def _vocab_rules(wide: str, cats: list[str], name_map: dict[str, str] | None = None, ns: str = "") -> str:
    """SQL producing (namespace, category, is_multi, is_prefix, key, n) from a wide CTE."""
    arms = " union all ".join(
        f"select {_q((name_map or {}).get(c, c))} category, lower(trim(\"DicTerm\")) term from {wide} where upper(trim({c})) = 'X'" for c in cats
    )
    return f"""(select {_q(ns)} namespace, category, is_multi, is_prefix, key, count(*) n from (
        select category, len(string_split_regex(trim(term), '\\s+')) > 1 is_multi, ends_with(term, '*') is_prefix,
               case when ends_with(term, '*') then trim(left(term, length(term) - 1)) else term end key
        from ({arms}) a where term is not null and term <> '') b
      where key <> '' group by all)"""


def _vocab_table(rules: str) -> str:
    return f"""(select namespace, category, case when is_prefix then 'prefix' else 'exact' end match_kind, is_multi, key,
        length(key)::int key_len, len(string_split_regex(key, '\\s+'))::int n_words,
        (case when is_prefix then n else 1 end)::bigint weight from {rules})"""


def _ptukey(src: str, out: str) -> str:
    """CTE ``out`` (q, p): P(Q <= q) for every q of ``src``, as two sums: the range probabilities on a
    grid of width 0.01 and the density of s at s = j * 0.01 / q, relative to s = 1."""
    return f"""{out} as (select q, sum(d * coalesce(r, 1.0)) / sum(d) p from (
  select q, j, exp((df - 1) * ln(j * 0.01 / q) - df * (pow(j * 0.01 / q, 2) - 1) / 2) d from (
    select q, df, unnest(range(greatest(1, floor(100 * q * (1 - 9 / sqrt(2 * df))))::bigint, ceil(100 * q * (1 + 9 / sqrt(2 * df)))::bigint + 1)) j
    from (select distinct q from {src}) x, tot)) y left join rng using (j) group by q)"""


def _tukey_sql(an_cte: str, cat: str, val: str, least: float = 0.01) -> str:
    """``least``: below this q the probability of a smaller range counts as 0."""
    return f"""{_groups_sql(an_cte, cat, val)},
tot as (select (sum(n) - count(*))::double df, count(*) k, sum(coalesce((n - 1) * var, 0.0)) / (sum(n) - count(*)) mse from gp),
pr as (select a.grp::varchar group1, b.grp::varchar group2, b.mean - a.mean diff, sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) se,
         abs(b.mean - a.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) q from gp a join gp b on a.grp < b.grp, tot),
z as (select i, -9 + i * 0.01::double z, exp(-pow(-9 + i * 0.01::double, 2) / 2) / sqrt(2 * pi()) f from range(0, 1801) t(i)),
cdf as (select i, f, 0.01 * (sum(f) over (order by i) - f / 2) + 0.0001 / 12 * z * f c from z),
rng as (select j, max(k) * sum(0.01 * a.f * pow(greatest(a.c - coalesce(b.c, 0.0), 0.0), k - 1)) r
        from (select i j, k from range(0, 1201) t(i), tot) g cross join cdf a left join cdf b on b.i = a.i - g.j group by j),
{_ptukey("pr", "pp")},
coarse as (select 0.5 + i * 0.05 q from range(0, 2000) t(i)),
{_ptukey("coarse", "pc")},
fine as (select (select max(q) from pc where p < 0.95) + i * 0.0005 q from range(0, 102) t(i)),
{_ptukey("fine", "pf")},
lo as (select max_by(q, p) q0, max(p) p0 from pf where p < 0.95),
hi as (select min_by(q, p) q1, min(p) p1 from pf where p >= 0.95),
crit as (select q0 + (q1 - q0) * (0.95 - p0) / (p1 - p0) qc from lo, hi)
select group1, group2, round(diff, 4) + 0.0 meandiff, case when q < {least} then 1.0 else round(1 - p, 4) end "p-adj", round(diff - qc * se, 4) "lower", round(diff + qc * se, 4) "upper", q >= {least} and 1 - p < 0.05 reject
from pr join pp using (q), crit"""


BENCH_CATS = ["short", "medium", "long", "phrase"]


def _bench_vocab() -> str:
    return f"with {BENCH_WIDE},\nvocab as {_vocab_table(_vocab_rules('wide', BENCH_CATS))}"


# --------------------------------------------------------------------------- #
# the oracle table
# --------------------------------------------------------------------------- #
def _sql_counts(wordlist, cats, max_n=3, convention="tokens") -> str:
    return f"""with {_tk()},
{_match(wordlist, max_n, convention)}
select t.k doc_id, {', '.join(_wide_cols(cats, perc=False))} from t left join c on t.k = c.k group by t.k"""


def _enhance_select(extra_where: str = "", drop_text: bool = False, tail: str = "") -> str:
    cols = ["d.doc_id"] + ([] if drop_text else ["d.text"]) + ["d.lang", "d.source", "d.n_chars", "an.n_tokens", "an.n_types"]
    for c in CATEGORIES:
        cols += [f"an.{c}_word_count", f"round(an.{c}_word_perc, 6) {c}_word_perc", f"an.{c}_detected_words"]
    return f"""{_analysis_cte(extra='', det=True)}
select {', '.join(cols)} from documents d join an on d.doc_id = an.k {extra_where} {tail}"""


def _top_sql(cat_filter: str, k: int, by: str, cols: str) -> str:
    return f"""{_analysis_cte()},
f as (select cat category, term, sum(occ)::bigint frequency, count(*)::bigint doc_frequency from h group by all),
r as (select *, row_number() over (partition by category order by {by} desc, term asc)::int rank from f {cat_filter})
select {cols} from r where rank <= {k}"""


def _ngram_top_sql(n: int, k: int = 25) -> str:
    return f"""with {_tk(extra='lang')},
g as (select k, lang, unnest(list_transform(range(1, len(tk) - {n} + 2), lambda i: array_to_string(tk[i:i+{n - 1}], ' '))) term from t),
o as (select k, lang, term, count(*) occ from g group by all),
f as (select lang, term, sum(occ)::bigint frequency, count(*)::bigint doc_frequency from o group by all),
r as (select *, row_number() over (partition by lang order by frequency desc, term asc)::int rank from f)
select lang, rank, term, frequency, doc_frequency from r where rank <= {k}"""


def _file_order(summary: str) -> str:
    """The summary with prefixes ordered by the hash of their cells, as they stand in the file."""
    cells = " union all ".join(f"select '{c}' category, \"DicTerm\" cell from wide where upper(trim({c})) = 'X'" for c in BENCH_CATS)
    places = f"""places as (select category, len(string_split_regex(trim(lower(cell)), '\\s+')) > 1 is_multi,
  trim(left(lower(trim(cell)), length(trim(cell)) - 1)) key, min(md5(cell)) place from ({cells}) where ends_with(trim(cell), '*') group by all),
s as ("""
    summary = summary.replace("wide as (", "cells as (", 1).replace("vocab as (", "wide as (select * from cells where ends_with(\"DicTerm\", '*')),\nvocab as (", 1)
    summary = summary.replace("\ns as (", "\n" + places, 1)
    summary = summary.replace("then key || '*' else key end term from vocab)", "then key || '*' else key end term, case when match_kind = 'prefix' then place end place from vocab left join places using (category, is_multi, key))")
    # the categories without a prefix have no entries
    return summary.replace("order by r, term) i", "order by r, place, term) i") + "\nunion all select 'medium', 0, '' union all select 'short', 0, ''"


def oracle_sql() -> dict[str, str]:
    perc_cols = ", ".join(f"round({c}_word_perc, 6) {c}_word_perc" for c in CATEGORIES)
    wide = ", ".join(f"{c}_word_count, round({c}_word_perc, 6) {c}_word_perc" for c in CATEGORIES)
    q: dict[str, str] = {}
    q["tokenize_stats"] = f"with {_tk()} select k doc_id, len(tk)::bigint n_tokens, len(list_distinct(tk))::bigint n_types from t"
    q["token_freq_by_lang"] = f"""with {_tk(extra='lang')},
g as (select k, lang, unnest(tk) term from t),
o as (select k, lang, term, count(*) occ from g group by all)
select lang, term, sum(occ)::bigint frequency, count(*)::bigint doc_frequency from o group by all"""
    q["ngram_bigrams_top"] = _ngram_top_sql(2)
    q["ngram_trigrams_top"] = _ngram_top_sql(3)
    q["clean_and_tokenize"] = f"""with {_tk()},
gg as (select k, tk, list_concat(list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i+1], ' ')),
                               list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i+2], ' '))) grams from t)
select k doc_id, len(tk)::bigint n_tokens, len(grams)::bigint n_ngrams, len(list_distinct(grams))::bigint n_distinct_ngrams from gg"""
    q["exact_single_counts"] = _sql_counts({"art": TEST_WORDLIST["art"]}, ["art"])
    q["prefix_single_counts"] = _sql_counts(PREFIX_SINGLE_WORDLIST, ["pfx"])
    q["exact_multi_counts"] = _sql_counts(EXACT_MULTI_WORDLIST, ["phx"])
    q["prefix_multi_counts"] = _sql_counts(PREFIX_MULTI_WORDLIST, ["php"])
    q["overlap_double_count"] = _sql_counts(OVERLAP_WORDLIST, ["ov"])
    q["analyze_wide"] = f"{_analysis_cte(extra='')}\nselect k doc_id, n_tokens, n_types, {wide} from an"
    q["analyze_join_plan"] = q["analyze_wide"]
    q["stream_analyze"] = q["analyze_wide"]
    q["word_perc"] = f"{_analysis_cte(extra='')}\nselect k doc_id, {perc_cols} from an"
    q["detected_long"] = f"{_analysis_cte(extra='')}\nselect k doc_id, cat category, term, occ from h"
    q["detected_parse"] = q["detected_long"]
    q["detected_display"] = (
        f"{_analysis_cte(extra='', det=True)}\nselect k doc_id, " + ", ".join(f"{c}_detected_words" for c in CATEGORIES) + " from an"
    )
    q["term_matches"] = f"""with {_tk()},
{_match(TEST_WORDLIST, 3)}
select o.k doc_id, v.cat category, o.term, o.occ, v.w::bigint weight, case when v.kind = 'e' then 'exact' else 'prefix' end match_kind
from o join v on o.m = v.m and ((v.kind = 'e' and o.term = v.x) or (v.kind = 'w' and starts_with(o.term, v.x)))"""
    q["legacy_type_counts"] = _sql_counts(TEST_WORDLIST, CATEGORIES, max_n=5, convention="types")
    q["category_select"] = _sql_counts({k: TEST_WORDLIST[k] for k in ("art", "phr")}, ["art", "phr"])
    conv_cols = ", ".join(f"sum({c}_word_count)::bigint {c}_word_count, round(avg({c}_word_perc), 6) {c}_mean_perc" for c in CATEGORIES)
    q["conversation_roles_analyze"] = f"""with {_tk(table='conversations', key="conv_id::varchar || '/' || turn::varchar", extra='role')},
{_match(TEST_WORDLIST, 3)},
an as (select t.k, t.role, len(t.tk)::bigint n_tokens, {', '.join(_wide_cols(CATEGORIES, rnd=False))} from t left join c on t.k = c.k group by t.k, t.tk, t.role)
select role, count(*)::bigint n_turns, sum(n_tokens)::bigint n_tokens, {conv_cols} from an group by role"""
    q["corpus_term_freq"] = f"{_analysis_cte(extra='')}\nselect cat category, term, sum(occ)::bigint frequency, count(*)::bigint doc_frequency from h group by all"
    q["top_terms_one_category"] = _top_sql("where category = 'prep'", 10, "frequency", "rank, term, frequency, doc_frequency")
    q["top_terms_all_categories"] = _top_sql("", 5, "frequency", "category, rank, term, frequency, doc_frequency")
    q["top_terms_by_docs"] = _top_sql("", 3, "doc_frequency", "category, rank, term, doc_frequency")
    q["enhance"] = _enhance_select()
    # CSV/TSV cannot tell an empty string from a missing cell: empty cells read back as missing.
    rt_cols = ["doc_id", "nullif(text, '') text", "nullif(lang, '') lang", "nullif(source, '') source", "n_chars", "n_tokens", "n_types"]
    for c in CATEGORIES:
        rt_cols += [f"{c}_word_count", f"{c}_word_perc", f"nullif({c}_detected_words, '') {c}_detected_words"]
    q["csv_roundtrip"] = f"select {', '.join(rt_cols)} from ({q['enhance']})"
    q["tsv_roundtrip"] = q["csv_roundtrip"]
    q["parquet_roundtrip"] = q["enhance"]
    q["export_without_text"] = _enhance_select(drop_text=True)
    q["enhanced_page"] = _enhance_select(tail="order by d.doc_id limit 50 offset 100")
    q["sanitized_columns"] = f"""{_analysis_cte({"art": TEST_WORDLIST["art"]}, extra='', det=True)}
select d.doc_id "doc_id", d.lang "Lang", d.source "n_tokens", d.text "Text", an.n_tokens "n_tokens_2", an.n_types,
       an.art_word_count, round(an.art_word_perc, 6) art_word_perc, an.art_detected_words
from documents d join an on d.doc_id = an.k"""
    fields = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    q["dataset_profile"] = "with s as (select count(*) n, " + ", ".join(f"count(*) - count({c}) m{i}" for i, (c, _) in enumerate(fields)) + " from documents)\n" + " union all ".join(
        f"select {i}::int position, {_q(c)} column_name, {_q(t)} data_type, n::bigint n_rows, m{i}::bigint n_null from s" for i, (c, t) in enumerate(fields)
    )
    q["dataset_preview"] = "select * from documents order by doc_id limit 5"
    # vocabulary operators on the benchmark-derived wordlist
    q["vocab_unpivot"] = f"{_bench_vocab()}\nselect category, match_kind, is_multi, key, key_len, n_words, weight from vocab"
    m1 = {c: f"bench_{c}" for c in BENCH_CATS}
    m2 = {"short": "bench_short_2", "phrase": "bench_phrase_2"}
    order = ["bench_long", "bench_medium", "bench_phrase", "bench_short", "bench_phrase_2", "bench_short_2"]
    pos = "case category " + " ".join(f"when {_q(c)} then {i}" for i, c in enumerate(order)) + " end"
    q["vocab_merge"] = f"""with {BENCH_WIDE},
v1 as {_vocab_table(_vocab_rules('wide', BENCH_CATS, m1, 'bench'))},
v2 as {_vocab_table(_vocab_rules('wide', ['short', 'phrase'], m2, 'bench'))}
select namespace, category, ({pos})::int category_pos, match_kind, is_multi, key, weight from (select * from v1 union all select * from v2)"""
    q["vocab_summary"] = f"""{_bench_vocab()},
s as (select category, weight, case when match_kind = 'exact' and not is_multi then 0 when match_kind = 'exact' then 1 when not is_multi then 2 else 3 end r,
             case when match_kind = 'prefix' then key || '*' else key end term from vocab),
rk as (select *, row_number() over (partition by category order by r, term) i from s)
select category, sum(weight)::bigint n_terms, string_agg(term, ', ' order by i) filter (where i <= 10) sample_terms from rk group by category"""
    q["vocab_head_tail"] = f"""{_bench_vocab()},
e as (select category, is_multi::int m, key from vocab where match_kind = 'exact'),
r as (select category, key, row_number() over (partition by category order by m, key) ra, count(*) over (partition by category) n from e),
s as (select category, n, string_agg(key, ', ' order by ra) all_terms,
             string_agg(key, ', ' order by ra) filter (where ra <= 3) head,
             string_agg(key, ', ' order by ra) filter (where ra > n - 3) tail from r group by category, n),
cats as (select distinct category from vocab)
select cats.category, coalesce(n, 0)::bigint n_terms,
       '**' || cats.category || ' (' || coalesce(n, 0) || ' terms):** ' ||
       case when n is null then 'None' when n <= 6 then all_terms else head || ', ... , ' || tail end || ';' summary
from cats left join s on cats.category = s.category"""
    q["analyze_table_vocab"] = f"""{_bench_vocab()},
{_tk()},
{_grams(3)},
ex as (select o.k, v.category, o.occ * v.weight c from o join vocab v
       on v.match_kind = 'exact' and o.m = (case when v.is_multi then 'm' else 's' end) and o.term = v.key),
pl as (select distinct key_len from vocab where match_kind = 'prefix'),
pr as (select o.k, v.category, o.occ * v.weight c from o join pl on length(o.term) >= pl.key_len
       join vocab v on v.match_kind = 'prefix' and v.key_len = pl.key_len and o.m = (case when v.is_multi then 'm' else 's' end)
                    and substring(o.term, 1, pl.key_len) = v.key)
select k doc_id, category, sum(c)::bigint word_count from (select * from ex union all select * from pr) group by all"""
    # statistics
    an_raw = _analysis_cte()
    q["pearson"] = _pearson_sql(an_raw, [("n_tokens", "art_word_perc")])
    cols = ["n_tokens", "n_types"] + [f"{c}_word_perc" for c in CATEGORIES]
    q["correlation_pairs"] = _pearson_sql(an_raw, [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))])
    q["ols_trend"] = f"""{an_raw},
s as (select regr_slope(art_word_count, n_tokens) slope, regr_intercept(art_word_count, n_tokens) intercept, regr_r2(art_word_count, n_tokens) r2,
             count(*)::bigint n, min(n_tokens)::double x_min, max(n_tokens)::double x_max from an)
select 'n_tokens' x, 'art_word_count' y, round(slope, 6) slope, round(intercept, 6) intercept, round(r2, 6) r2, n,
       round(x_min, 6) x_min, round(x_max, 6) x_max, round(intercept + slope * x_min, 6) y_at_min, round(intercept + slope * x_max, 6) y_at_max from s"""
    q["group_ci_t"] = _ci_sql(an_raw, "lang", "art_word_perc")
    q["group_ci_z"] = _ci_sql(an_raw, "source", "prep_word_perc", z=True)
    q["mean_bars"] = _ci_sql(an_raw, "source", "art_word_perc", bars=True)
    q["anova_table"] = _anova_sql(an_raw, "lang", "art_word_perc")
    an_lab = an_raw + ",\nal as (select an.*, l.quality from an join labels l on an.k = l.doc_id)"
    q["anova_labels"] = _anova_sql(an_lab, "quality", "conj_word_perc", source="al")
    q["tukey_pairs_stats"] = f"""{_groups_sql(an_raw, 'lang', 'art_word_perc')},
tot as (select (sum(n) - count(*))::double df, sum(coalesce((n - 1) * var, 0.0)) / (sum(n) - count(*)) mse from gp)
select a.grp::varchar group1, b.grp::varchar group2, round(b.mean - a.mean, 6) meandiff,
       round(sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) se,
       round(abs(b.mean - a.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) q, round(df, 6) df
from gp a join gp b on a.grp < b.grp, tot"""
    q["tukey_pairs"] = _tukey_sql(an_raw, "lang", "art_word_perc")
    q["anova_summary"] = f"""select 'lang' cat_var, 'art_word_perc' num_var, "PR(>F)" p_value, "PR(>F)" < 0.05 significant
from ({q['anova_table']}) where source <> 'Residual'"""
    q["scatter_points"] = f"{an_raw}\nselect n_tokens, art_word_count from an"
    # reports on display strings equal those on the maps
    q["top_terms_enhanced"] = q["top_terms_one_category"]
    q["top_terms_by_docs_enhanced"] = q["top_terms_by_docs"]
    q["corpus_terms_from_display"] = q["corpus_term_freq"]
    q["select_columns"] = f"select prep_word_count, doc_id, n_tokens from ({q['enhance']})"
    lists = ", ".join(f"coalesce(string_agg(o.term, ', ' order by o.term) filter (where o.cat = {_q(c)}), '') {c}_detected_words" for c in CATEGORIES)
    q["legacy_detected"] = f"""with {_tk()},
{_match(TEST_WORDLIST, 5, 'types')}
select t.k doc_id, {lists} from t left join h o on t.k = o.k group by t.k"""
    q["page_after_key"] = """select doc_id, lang, source, n_chars from documents
where source > 'src1' or (source = 'src1' and doc_id > 41) order by source, doc_id limit 40"""
    q["json_records_page"] = """select to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::varchar "value"
from documents order by doc_id limit 50 offset 100"""
    order = "case category when 'long' then 0 when 'medium' then 1 when 'phrase' then 2 when 'short' then 3 end"
    q["vocab_summary_empty_category"] = f"""select category, ({order})::int category_pos, n_terms, sample_terms from ({q['vocab_summary']})
union all select 'unused', 4, 0, ''"""
    q["vocab_head_tail_empty_category"] = f"""select category, ({order})::int category_pos, n_terms, summary from ({q['vocab_head_tail']})
union all select 'unused', 4, 0, '**unused (0 terms):** None;'"""
    q["vocab_terms_for"] = f"select match_kind, is_multi, key, weight from ({q['vocab_unpivot']}) where category = 'long'"
    q["vocab_union"] = f"""with {BENCH_WIDE},
v1 as {_vocab_table(_vocab_rules('wide', BENCH_CATS))},
v2 as {_vocab_table(_vocab_rules('wide', ['short', 'phrase']))}
select category, ({order})::int category_pos, match_kind, is_multi, key, weight from (select * from v1 union all select * from v2)"""
    q["wordlist_formats"] = f"""select f.fmt, category, match_kind, is_multi, key, weight
from ({q['vocab_unpivot']}), (values ('csv'), ('tsv')) f(fmt)"""
    q["csv_infer_na"] = "select doc_id, (case when quality = 1 then toxic end)::double / 2 half_score from labels"
    q["read_usecols_dtype"] = "select n_chars::varchar n_chars, doc_id, nullif(lang, '') lang from documents"
    pivot = ", ".join(f"coalesce(sum(word_count) filter (where category = {_q(c)}), 0)::bigint {c}_word_count" for c in BENCH_CATS)
    q["analyze_large_vocab_nokey"] = f"""select d.doc_id, any_value(n_tokens) n_tokens, {pivot}
from ({q['tokenize_stats']}) d left join ({q['analyze_table_vocab']}) w on d.doc_id = w.doc_id group by d.doc_id"""
    q["analyze_duplicate_and_null_keys"] = f"""select case when doc_id % 3 <> 0 then (doc_id % 100)::varchar end k, n_tokens, n_types,
{', '.join(f'{c}_word_count' for c in CATEGORIES)} from ({q['analyze_wide']})"""
    li = "with li0 as (select 1)"
    q["pearson_lineitem"] = _pearson_sql(li, [("l_quantity", "l_extendedprice")], source="lineitem")
    q["group_ci_lineitem"] = _ci_sql(li, "l_returnflag", "l_extendedprice", source="lineitem")
    q["anova_lineitem"] = _anova_sql(li, "l_linestatus", "l_discount", source="lineitem")
    q["stream_term_totals"] = q["corpus_term_freq"]
    q["csv_infer_types"] = """select doc_id, length(nullif(text, ''))::bigint n_chars, case when doc_id % 2 = 0 then 'yes' else 'no' end yes_no,
 case when doc_id % 3 = 0 then 't' else 'f' end t_f, (doc_id % 90) || case when doc_id % 2 = 0 then 'd' else 'f' end code, doc_id % 2 = 0 truth,
 case when doc_id % 5 <> 0 then (doc_id % 7)::double end gaps, round((doc_id % 8) * pow(10.0, doc_id % 5 - 2), 6) power,
 'doc_id bigint, text string, yes_no string, t_f string, code string, truth boolean, gaps double, power double' types from documents"""
    q["numbers_as_text"] = f"""with v as (select l_orderkey, l_linenumber, case l_linenumber when 1 then l_extendedprice::double * 1e12::double
   when 2 then l_extendedprice::double * 1e-9::double when 3 then floor(l_extendedprice::double) else l_extendedprice::double end::varchar printed from lineitem)
select l_orderkey, l_linenumber, printed, array_to_string(regexp_extract_all(lower(printed), {TOKEN_SQL}), '|') tokens from v"""
    q["tokens_and_ngrams"] = f"""with {_tk()}
select k doc_id, array_to_string(list_concat(tk, list_concat(list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i+1], ' ')),
  list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i+2], ' ')))), '|') terms from t"""
    q["xlsx_roundtrip"] = "select doc_id, nullif(text, '') \"text\", nullif(lang, '') lang, nullif(source, '') source, n_chars from documents"
    q["indexed_pages"] = """with r as (select doc_id, lang, source, n_chars, row_number() over (order by source nulls first, doc_id) - 1 i, count(*) over () n from documents)
select doc_id, lang, source, n_chars, case when i < 20 then 0 when i between 130 and 169 then 1 else 2 end page from r
where i < 20 or i between 130 and 169 or (i >= n * 3 // 4 and i < n * 3 // 4 + 60)"""
    q["export_chunks"] = """with r as (select source, doc_id, (row_number() over (order by source nulls first, doc_id) - 1) i from documents),
c as (select i // 300 chunk, count(*) "rows", min(i) a, max(i) b from r group by i // 300)
select chunk::bigint chunk, "rows", to_json({'source': f.source, 'doc_id': f.doc_id})::varchar first_key, to_json({'source': l.source, 'doc_id': l.doc_id})::varchar last_key
from c join r f on f.i = a join r l on l.i = b"""
    q["top_terms_threshold"] = q["top_terms_all_categories"]
    q["top_terms_threshold_by_docs"] = q["top_terms_by_docs"]
    q["tukey_many_groups"] = _tukey_sql("with an as (select lang || '/' || source grp_name, n_chars::double / 1e6 size from documents)", "grp_name", "size", 1.0)
    q["scatter_sample"] = """with p as (select l_orderkey || '-' || l_linenumber "key", l_quantity::double x, l_extendedprice::double y from lineitem),
e as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from p),
c as (select "key", x, y, least(15, floor((x - x0) / (x1 - x0) * 16))::int cell_x, least(15, floor((y - y0) / (y1 - y0) * 16))::int cell_y from p, e),
r as (select *, row_number() over (partition by cell_x, cell_y order by md5("key"), x, y) i, count(*) over (partition by cell_x, cell_y) n_cell from c)
select "key", x, y, cell_x, cell_y, n_cell from r where i <= 3"""
    kept = " or ".join(f"(cat = {_q(c)} and k % 4 <> {i})" for i, c in enumerate(CATEGORIES))
    q["missing_detected_cells"] = f"""{_analysis_cte()}
select cat category, term, sum(occ)::bigint frequency, count(*)::bigint doc_frequency from h where {kept} group by cat, term"""
    q["json_records_nan"] = """select to_json({'doc_id': doc_id, 'half': case when doc_id % 3 = 1 then n_chars::double / 2 end})::varchar "value"
from documents order by doc_id limit 90"""
    roles = {
        "documents": [("text", c) for c in ("text", "lang", "source")] + [("numeric", c) for c in ("doc_id", "n_chars")] + [("category", c) for c in ("text", "lang", "source")],
        "labels": [("numeric", c) for c in ("doc_id", "quality", "toxic")],
        "lineitem": LINEITEM_ROLES,
    }
    q["column_roles"] = " union all ".join(f"select '{t}' table_name, '{r}' \"role\", '{c}' column_name, count(distinct {c}) n_distinct from {t}" for t, cs in roles.items() for r, c in cs)
    codes = {
        "no DicTerm column": "missing_dicterm_column", "no category column": "no_category_columns", "unknown category": "unknown_category",
        "no text column": "no_text_column", "unknown column": "unknown_column", "unsupported format": "unsupported_format",
    }
    q["vocab_summary_file_order"] = _file_order(q["vocab_summary"])
    q["error_codes"] = " union all ".join(f"select '{m}' misuse, '{c}' code, count(*) n_documents from documents" for m, c in codes.items())
    return q
