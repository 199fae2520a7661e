"""Statistics over (enhanced) columns as DataFrame aggregations (AGG-7..13, JN-4, PLT-2/3).

The data pass is always a Spark aggregate (partial + final, algebraic, so a
hot group is combined map-side).  Only the aggregated rows -- one per
statistic, group or group pair -- go through the Arrow UDFs in
:mod:`termlens.functions.distributions` for tail probabilities and quantiles.
Errors the reference raises (too few rows, constant column, one group) are
raised lazily inside the plan with ``raise_error``, so nothing is collected to
decide them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termlens.errors import StatisticsError, require_columns
from termlens.functions.distributions import f_sf_udf, pearson_p_udf, qtukey, t_ppf_udf, tukey_q_udf, tukey_sf_column, tukey_sf_udf
from termlens.functions.text import explode_rows
from termlens.session import stage_table

# Significance level 0.05; confidence 0.95; the legacy interval
# uses z = 1.96; the Tukey summary rounds to 4 decimals.
ALPHA = 0.05
CONFIDENCE = 0.95
LEGACY_Z = 1.96
TUKEY_DECIMALS = 4
# with more groups than this, their pairs read the studentized range from one table
TABLE_GROUPS = 40
# with more columns than this, correlations come from sums of cross products
WIDE = 16


def _clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT-1: listwise deletion of null and NaN on exactly these columns (a row filter)."""
    require_columns(df.columns, list(cols))
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(f"`{c}`").isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            complete = complete & ~F.isnan(f"`{c}`")
    # above a generated column: a filter on the columns would be pushed below the projections that compute them
    row = F.when(complete, F.struct(*[F.col(f"`{c}`") for c in cols]))
    return explode_rows(df, [], F.array(row), "__row").select("__row.*")


def _valid(*cols: Column) -> Column:
    """Row is complete: every column non-null and not NaN (FLT-1 as an aggregate condition).

    Statistics use conditional aggregates instead of a Filter: a filter on
    computed columns would be pushed below the projections that compute them
    and evaluate the (expensive) text analysis twice.
    """
    cond = F.lit(True)
    for c in cols:
        cond = cond & c.isNotNull() & ~F.isnan(c.cast("double"))
    return cond


def _attach(rows: DataFrame, scalar_row: DataFrame) -> DataFrame:
    """Attach a one-row global aggregate to every row (broadcast equi-join on a constant)."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(scalar_row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def _fail(cond: Column, msg: str, value: Column) -> Column:
    return F.when(cond, F.raise_error(F.lit(msg))).otherwise(value)


# --------------------------------------------------------------------------- #
# correlation
# --------------------------------------------------------------------------- #
def pearson(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """One row ``(col1, col2, coefficient, p_value, n)`` (AGG-8)."""
    if col1 == col2:
        raise StatisticsError(f"a column has no correlation with itself to test: {col1!r}")
    require_columns(df.columns, [col1, col2])
    x0, y0 = F.col(f"`{col1}`").cast("double"), F.col(f"`{col2}`").cast("double")
    ok = _valid(x0, y0)
    pair = df.select(F.when(ok, x0).alias("x"), F.when(ok, y0).alias("y"))
    agg = pair.agg(
        F.count("x").alias("n"),
        F.covar_samp("x", "y").alias("cov"),
        F.stddev_samp("x").alias("sx"),
        F.stddev_samp("y").alias("sy"),
        # merged moments can leave a trace of variance in a constant column, its ends do not
        (F.min("x") == F.max("x")).alias("flat_x"),
        (F.min("y") == F.max("y")).alias("flat_y"),
    )
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("cov"), F.col("sx") * F.col("sy"))))
    # checked in the reference's order: too few pairs first, then constant columns
    r = _fail(F.col("flat_x") | F.col("flat_y"), f"correlation undefined: there is no variance in {col1!r} or in {col2!r}", r)
    r = _fail(F.col("n") < 2, f"correlation undefined: {col1!r} and {col2!r} share too few rows (at least 2)", r)
    res = agg.select(F.col("n").cast("bigint").alias("n"), r.alias("coefficient"))
    return res.select(
        F.lit(col1).alias("col1"),
        F.lit(col2).alias("col2"),
        "coefficient",
        pearson_p_udf("coefficient", "n").alias("p_value"),
        "n",
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r, p and n for every pair of ``columns`` in ONE data pass.

    Each pair does its own listwise deletion (conditional aggregates), exactly
    as calling :func:`pearson` per pair would.  Constant pairs get null r/p
    instead of failing the whole matrix.  More than ``WIDE`` columns go through
    :func:`_cross_products`, whose plan does not grow with the number of pairs.
    """
    cols = list(columns)
    require_columns(df.columns, cols)
    if len(cols) > WIDE:
        return _with_p_values(_cross_products(df, cols))
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        xa, yb = F.when(both, x), F.when(both, y)
        aggs += [
            F.count(F.when(both, 1)).alias(f"n{i}"),
            F.covar_samp(xa, yb).alias(f"c{i}"),
            F.stddev_samp(xa).alias(f"sx{i}"),
            F.stddev_samp(yb).alias(f"sy{i}"),
            ((F.min(xa) == F.max(xa)) | (F.min(yb) == F.max(yb))).alias(f"flat{i}"),
        ]
    agg = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("col1"),
                F.lit(b).alias("col2"),
                F.when(~F.col(f"flat{i}"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(f"c{i}"), F.col(f"sx{i}") * F.col(f"sy{i}"))))).alias("coefficient"),
                F.col(f"n{i}").cast("bigint").alias("n"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    long = agg.select(F.explode(rows).alias("r")).select("r.*")
    coef = F.when((F.col("n") >= 2) & ~F.isnan("coefficient"), F.col("coefficient"))
    return _with_p_values(long.withColumn("coefficient", coef))


def _with_p_values(long: DataFrame) -> DataFrame:
    return long.select("col1", "col2", "coefficient", F.when(F.col("coefficient").isNotNull(), pearson_p_udf("coefficient", "n")).alias("p_value"), "n")


def _cross_products(df: DataFrame, cols: list[str]) -> DataFrame:
    """``col1, col2, coefficient, n`` of all pairs of many columns, in two passes.

    The first takes the columns' means; the second sums, for every pair, the products of the centred
    values over the rows where both are there: matrix products in each task, one row per pair and task,
    added up by Spark.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.agg(*[F.avg(F.when(_valid(F.col(c)), F.col(c))).alias(c) for c in values.columns]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])
    i, j = np.triu_indices(len(cols), 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(cols), len(cols)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            there = there.astype(float)
            total += [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x]
        sums = [pa.array(t[i, j]) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *sums], ["i", "j", *names])

    width, id_ = len(cols), F.col("id")
    # a row of zeros for every pair, so that pairs without data are there
    zeros = df.sparkSession.range(width * width).select(F.floor(id_ / width).cast("int").alias("i"), (id_ % width).cast("int").alias("j"), *[F.lit(0.0).alias(n) for n in names])
    sums = values.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names)).unionByName(zeros.where("i < j"))
    sums = sums.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    vx, vy = sxx - F.try_divide(sx * sx, n), syy - F.try_divide(sy * sy, n)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(vx * vy))))
    # what rounding leaves of a constant is no variance
    r = F.when((n >= 2) & (vx > sxx * 1e-13) & (vy > syy * 1e-13) & ~F.isnan(r), r)
    names_of = F.lit(cols)
    return sums.select(F.get(names_of, F.col("i")).alias("col1"), F.get(names_of, F.col("j")).alias("col2"), r.alias("coefficient"), n.cast("bigint").alias("n"))


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS of y on x (AGG-11 / PLT-3 line): slope, intercept, r2, n and the fitted ends."""
    require_columns(df.columns, [x, y])
    x0, y0 = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    ok = _valid(x0, y0)
    pair = df.select(F.when(ok, x0).alias("x"), F.when(ok, y0).alias("y"))
    agg = pair.agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.count("x").cast("bigint").alias("n"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )
    return agg.select(
        F.lit(x).alias("x"),
        F.lit(y).alias("y"),
        "slope",
        "intercept",
        "r2",
        "n",
        "x_min",
        "x_max",
        (F.col("intercept") + F.col("slope") * F.col("x_min")).alias("y_at_min"),
        (F.col("intercept") + F.col("slope") * F.col("x_max")).alias("y_at_max"),
    )


def scatter_points(df: DataFrame, x: str, y: str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """PLT-3 points; ``fraction`` samples for display (sampling is the feature here)."""
    pair = _clean(df, [x, y])
    return pair.sample(fraction=fraction, seed=seed) if fraction else pair


def scatter_sample(df: DataFrame, x: str, y: str, key: str, cells: int = 32, per_cell: int = 8) -> DataFrame:
    """PLT-3 points, at most ``cells * cells * per_cell`` of them at any input, the same on every run.

    The plane is cut into ``cells`` by ``cells`` cells; of each the ``per_cell`` points with the smallest
    hash of ``key`` stay, next to ``n_cell``, the number of points in the cell.  Hashes merge: every task
    keeps its own smallest ones before the shuffle, so a cell that holds a third of all points does not
    fill a task.  Returns ``key, x, y, cell_x, cell_y, n_cell``.
    """
    require_columns(df.columns, [x, y, key])
    a, b = (F.col(f"`{c}`").cast("double") for c in (x, y))
    points = df.select(F.col(f"`{key}`").alias("key"), a.alias("x"), b.alias("y")).where(_valid(F.col("x")) & _valid(F.col("y")))
    edges = points.agg(*[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str) -> Column:
        share = F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
        return F.least(F.lit(cells - 1), F.floor(F.coalesce(share, F.lit(0.0)) * cells)).cast("int")

    dealt = _attach(points, edges).select("key", "x", "y", cell("x").alias("cell_x"), cell("y").alias("cell_y"))
    counts = dealt.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).cast("bigint").alias("n_cell"))
    order = Window.partitionBy("cell_x", "cell_y").orderBy(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), "x", "y")
    few = dealt.withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= per_cell).drop("__i")
    return few.join(counts, ["cell_x", "cell_y"]).select("key", "x", "y", "cell_x", "cell_y", "n_cell")


# --------------------------------------------------------------------------- #
# group descriptives, ANOVA, Tukey
# --------------------------------------------------------------------------- #
def _groups(df: DataFrame, cat_var: str, num_var: str) -> DataFrame:
    """Per group (n, mean, var) over complete rows; partial aggregation combines a hot group map-side."""
    require_columns(df.columns, [cat_var, num_var])
    g0, v0 = F.col(f"`{cat_var}`"), F.col(f"`{num_var}`").cast("double")
    if df.schema[cat_var].dataType.typeName() in ("float", "double"):
        g0 = F.when(~F.isnan(g0), g0)  # NaN is a missing label too
    v = F.when(_valid(v0) & g0.isNotNull(), v0)
    agg = df.select(g0.alias("__g"), v.alias("__v")).groupBy("__g").agg(
        F.count("__v").cast("bigint").alias("n"),
        F.avg("__v").alias("mean"),
        F.var_samp("__v").alias("var"),
    )
    # the null-label group and groups without a complete row are dropped (small table)
    return agg.filter(F.col("__g").isNotNull() & (F.col("n") > 0))


def group_statistics(df: DataFrame, cat_var: str, num_var: str, confidence: float = CONFIDENCE, interval: str = "t") -> DataFrame:
    """Per group ``(category, n, mean, sem, ci_lower, ci_upper)`` (AGG-7; ``interval="z"`` is AGG-13).

    sem is 0 when n == 1 or the group is constant, and the interval then
    collapses to the mean.  The t quantile is computed only for the k group rows.
    """
    g = _groups(df, cat_var, num_var)
    sem = F.coalesce(F.sqrt(F.col("var") / F.col("n")), F.lit(0.0))
    g = g.select("__g", "n", "mean", sem.alias("sem"))
    if interval == "t":
        q = F.when((F.col("n") >= 2) & (F.col("sem") != 0.0), t_ppf_udf(F.lit(1.0 - (1.0 - confidence) / 2.0), (F.col("n") - 1).cast("double")))
        half = F.coalesce(q * F.col("sem"), F.lit(0.0))
    elif interval == "z":
        half = F.lit(LEGACY_Z) * F.col("sem")
    else:
        raise StatisticsError("interval must be 't' or 'z'")
    return g.select(
        F.col("__g").cast("string").alias("category"),
        "n",
        "mean",
        "sem",
        (F.col("mean") - half).alias("ci_lower"),
        (F.col("mean") + half).alias("ci_upper"),
    ).orderBy("category")  # one row per group


def mean_bars(df: DataFrame, cat_var: str, num_var: str) -> DataFrame:
    """PLT-2 data: ``(category, mean, err_plus, err_minus)``, by mean ascending (ties by category)."""
    s = group_statistics(df, cat_var, num_var)
    return s.select("category", "mean", (F.col("ci_upper") - F.col("mean")).alias("err_plus"), (F.col("mean") - F.col("ci_lower")).alias("err_minus")).orderBy("mean", "category")


def anova_table(df: DataFrame, cat_var: str, num_var: str) -> DataFrame:
    """One-way ANOVA table (AGG-9): rows ``C(cat)`` and ``Residual`` with
    ``sum_sq, df, F, PR(>F)`` (F and p null on the residual row).

    Between/within sums come from per-group (n, mean, var) merged by Spark's
    stable variance aggregate, not from sum-of-squares differences.
    """
    g = _groups(df, cat_var, num_var)
    tot = g.agg(
        F.sum("n").alias("n_total"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
    )
    j = _attach(g, tot)
    dev = F.col("mean") - F.col("grand_mean")
    # one row also without any group, so that the check below sees that
    s = j.agg(
        F.max("n_total").alias("n_total"),
        F.coalesce(F.max("k"), F.lit(0)).alias("k"),
        F.sum(F.col("n") * dev * dev).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"),
    )
    s = s.select(
        _fail(F.col("k") < 2, f"nothing to compare: {num_var!r} must have values in at least 2 groups of {cat_var!r}", F.col("ssb")).alias("ssb"),
        "ssw",
        (F.col("k") - 1).cast("double").alias("df_b"),
        (F.col("n_total") - F.col("k")).cast("double").alias("df_w"),
    )
    msb = F.try_divide(F.col("ssb"), F.col("df_b"))
    msw = F.try_divide(F.col("ssw"), F.col("df_w"))
    fstat = F.when((F.col("df_w") > 0) & (msw > 0), msb / msw).when((F.col("df_w") > 0) & (msb > 0), F.lit(float("inf")))
    s = s.select("*", fstat.alias("F"))
    s = s.select("*", F.when(F.col("F").isNotNull(), f_sf_udf("F", "df_b", "df_w")).alias("p"))
    rows = F.array(
        F.struct(F.lit(f"C({cat_var})").alias("source"), F.col("ssb").alias("sum_sq"), F.col("df_b").alias("df"), F.col("F").alias("F"), F.col("p").alias("PR(>F)")),
        F.struct(F.lit("Residual").alias("source"), F.col("ssw").alias("sum_sq"), F.col("df_w").alias("df"), F.lit(None).cast("double").alias("F"), F.lit(None).cast("double").alias("PR(>F)")),
    )
    return s.select(F.explode(rows).alias("r")).select("r.*")


def anova_summary(df: DataFrame, cat_var: str, num_var: str, alpha: float = ALPHA) -> DataFrame:
    """``(cat_var, num_var, p_value, significant)`` read from the table by row name."""
    t = anova_table(df, cat_var, num_var).filter(F.col("source") == f"C({cat_var})")
    return t.select(F.lit(cat_var).alias("cat_var"), F.lit(num_var).alias("num_var"), F.col("`PR(>F)`").alias("p_value"), (F.col("`PR(>F)`") < alpha).alias("significant"))


def tukey_hsd(df: DataFrame, cat_var: str, num_var: str, alpha: float = ALPHA, rounded: bool = True) -> DataFrame:
    """Tukey-Kramer HSD for all group pairs (AGG-10, JN-4).

    ``(group1, group2, meandiff, p-adj, lower, upper, reject)`` with
    meandiff = mean2 - mean1, SE = sqrt(MSE/2 * (1/n1 + 1/n2)).  The pair table
    is a theta self-join of the k-row *group* table (k(k-1)/2 rows, the output
    itself), never of data rows.
    """
    g = _groups(df, cat_var, num_var)
    stats = pair_statistics(g, alpha)
    d = TUKEY_DECIMALS
    rnd = (lambda c: F.round(c, d)) if rounded else (lambda c: c)
    return stats.select(
        F.col("g1").cast("string").alias("group1"),
        F.col("g2").cast("string").alias("group2"),
        rnd(F.col("meandiff")).alias("meandiff"),
        rnd(F.col("p_adj")).alias("p-adj"),
        rnd(F.col("lower")).alias("lower"),
        rnd(F.col("upper")).alias("upper"),
        (F.col("p_adj") < alpha).alias("reject"),
    ).orderBy("group1", "group2")


def pair_statistics(g: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per group pair: meandiff, se, q, df, k and Tukey p / interval (unrounded).

    With more than ``TABLE_GROUPS`` groups the distribution is tabulated once, and every pair is a
    column expression over the table; with fewer, each pair is integrated.
    """
    g = stage_table(g, "groups")  # one row for each group, read several times
    n_groups = g.count()
    tot = g.agg(
        F.sum("n").alias("n_total"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"),
    ).select(
        _fail(F.col("k") < 2, "Tukey HSD needs at least 2 groups", F.col("k")).alias("k"),
        (F.col("n_total") - F.col("k")).cast("double").alias("df"),
        F.try_divide(F.col("ssw"), (F.col("n_total") - F.col("k")).cast("double")).alias("mse"),
    )
    a = g.select(F.col("__g").alias("g1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    b = g.select(F.col("__g").alias("g2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    # every pair of blocks of groups meets under one key: an equi-join that spreads k * k / 2 pairs
    # over blocks * blocks keys, with neither side broadcast unless its size allows it
    blocks = max(1, math.isqrt(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = a.withColumn("b1", F.pmod(F.hash("g1"), F.lit(blocks))).withColumn("b2", others)
    b = b.withColumn("b2", F.pmod(F.hash("g2"), F.lit(blocks))).withColumn("b1", others)
    pairs = _attach(a.join(b, ["b1", "b2"]).where(F.col("g1") < F.col("g2")), tot)
    se = F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    p = pairs.select(
        "g1", "g2", "k", "df",
        (F.col("m2") - F.col("m1")).alias("meandiff"),
        se.alias("se"),
    ).withColumn("q", F.try_divide(F.abs(F.col("meandiff")), F.col("se")))
    known = tot.first() if n_groups > TABLE_GROUPS else None
    if known is None or not known["df"] > 0:
        p = p.withColumn("p_adj", tukey_sf_udf("q", "k", "df")).withColumn("qcrit", tukey_q_udf(F.lit(1.0 - alpha), "k", "df"))
    else:  # k and df are those of the whole test: one table serves all pairs
        at = (int(known["k"]), float(known["df"]))
        p = p.withColumn("p_adj", tukey_sf_column(F.col("q"), *at)).withColumn("qcrit", F.lit(float(qtukey(1.0 - alpha, *at))))
    return p.select(
        "g1", "g2", "k", "df", "meandiff", "se", "q", "p_adj",
        (F.col("meandiff") - F.col("qcrit") * F.col("se")).alias("lower"),
        (F.col("meandiff") + F.col("qcrit") * F.col("se")).alias("upper"),
    )


def tukey_pair_statistics(df: DataFrame, cat_var: str, num_var: str) -> DataFrame:
    """The part of Tukey HSD without its distribution: ``(group1, group2, meandiff, se, q, df)``."""
    return pair_statistics(_groups(df, cat_var, num_var)).select(
        F.col("g1").cast("string").alias("group1"), F.col("g2").cast("string").alias("group2"), "meandiff", "se", "q", "df"
    )
