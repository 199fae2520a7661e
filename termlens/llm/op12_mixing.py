"""A time-varying curriculum that mixes sources to target weights (DataFrame functions only).

Every source has a weight, and a schedule of its weight over training time 0..1: straight lines
between knots, scaled to an integral of one.  Its integral times the source's target is the source's
cumulative demand of words.  The documents of a source stand in a fixed random order that is repeated
as often as the demand asks for; an occurrence that begins after c words is needed when the cumulative
demand reaches c, so its training position is the inverse of the demand at c.  Documents are then
sorted by ranges of position.

Targets: all sources share the words of the corpus by weight; a target stops at ``limit`` times its
source's words and the excess is shared again by weight until none is above.  Levels are exact
integers; a source takes its target rounded to whole words, so its last document may be cut.

No task holds a source: running totals are summed over buckets of the order first, then within each
bucket.  Rows equal in ``by``, source and text count as copies of one another: they meet in the
partial aggregate, and are told apart again in blocks.

Defined results: a null text has size 0; a row of size 0 takes nothing and has no position; a null
source is a source, after all others; equal rows take alike up to their place in the order, and which
of them comes first shows in no column; very long texts are only counted; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termlens.llm.common import keep, table

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
LIMIT = 3  # no target is above so many times the words of its source
# Schedules of the three weight classes: level, falling and rising (time, height) knots.
SHAPES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
ROWS = 2_000  # of a source in a bucket, about
BLOCK = 10_000  # copies made from one row at once

Shape = tuple[tuple[float, float], ...]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def scaled(shape: Shape) -> list[tuple[float, float, float, float, float]]:
    """Pieces (start, length, height, slope, area before) of a schedule scaled to an area of one."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(shape, shape[1:]))
    if area <= 0 or min(h for _, h in shape) < 0 or any(b[0] <= a[0] for a, b in zip(shape, shape[1:])):
        raise ValueError("a schedule needs rising times, heights of 0 or more and an area above 0")
    pieces, before = [], 0.0
    for (t0, h0), (t1, h1) in zip(shape, shape[1:]):
        pieces.append((t0, t1 - t0, h0 / area, (h1 - h0) / area / (t1 - t0), before))
        before += (t1 - t0) * (h0 + h1) / 2 / area
    return pieces


def reached(share: Column, shape: Shape) -> Column:
    """The time at which the integral of the schedule is ``share`` (0 <= share < 1)."""
    when = None
    for t0, length, height, slope, before in reversed(scaled(shape)):
        rest = share - F.lit(before)
        # the root of height * x + slope / 2 * x**2 = rest without cancellation
        base = F.lit(height) + F.sqrt(F.greatest(F.lit(height * height) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.lit(t0) + F.when(rest > 0, F.least(F.lit(2.0) * rest / base, F.lit(length))).otherwise(F.lit(0.0))
        when = at if when is None else F.when(share < F.lit(before_next), at).otherwise(when)
        before_next = before
    return when


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source_key, source_size, class, target, quota) of every source of ``rows`` (source, size, copies)."""
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    # rank by ranges: parts sorted by source, then places within each part after the parts before
    order = F.col("source").asc_nulls_last()
    parts = keep(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("before") - 1
    number = F.pmod(place, F.lit(len(weights))).cast("int")
    ranked = parts.join(before, "part").withColumn("class", number)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), number + 1))
    ranked = keep(ranked.select(_source_key(F.col("source")).alias("source_key"), "source_size", "class", "weight"), "mix-weights")

    # the level: words for each unit of weight, words / units, raised until no target is above its limit
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cap = wide("source_size") * F.lit(limit)
    first = ranked.agg(F.sum(wide("source_size")).alias("words"), F.sum("weight").alias("units")).first()
    total = words = int(first["words"] or 0)
    units, closed = int(first["units"] or 0), 0
    while True:
        above = cap * F.lit(units).cast("decimal(18,0)") < wide("weight") * F.lit(words).cast("decimal(19,0)")
        got = ranked.agg(
            F.coalesce(F.sum(F.when(above, wide("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("units"),
            F.count(F.when(above, True)).alias("closed"),
        ).first()
        if got["closed"] == closed:
            break
        words, units, closed = total - limit * int(got["size"]), int(got["units"]), got["closed"]
        if not units:
            above = F.lit(True)
            break
    share = F.lit(words).cast("long") * F.col("weight") / F.lit(max(units, 1)).cast("double")
    target = F.when(above, (F.col("source_size") * limit).cast("double")).otherwise(share)
    return ranked.select("source_key", "source_size", "class", target.alias("target"), F.floor(target + 0.5).alias("quota"))


def plan(
    docs: DataFrame,
    by: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    shapes: tuple[Shape, ...] = SHAPES,
    limit: int = LIMIT,
) -> DataFrame:
    """One row for every row of ``docs``: the columns ``by`` in a struct ``row``, size, source_size,
    target, taken, and ``takes``: an array of (repeat, words, position), one for each occurrence."""
    if len(shapes) != len(weights):
        raise ValueError("one schedule for each weight")
    body = F.col(text)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], n_words(body).cast("string"))
    rows = docs.select(F.struct(*by).alias("row"), F.col(source).cast("string").alias("source"), n_words(body).alias("size"), F.md5(name.cast("binary")).alias("place"), F.xxhash64(body).alias("tie"))
    # copies meet before the shuffle: what is written has one row for each different one
    rows = keep(rows.groupBy("row", "source", "size", "place", "tie").agg(F.count("*").alias("copies")), "mix-rows")
    totals = keep(sources(rows, weights, limit), "mix-targets")

    most = rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = 1
    while buckets * ROWS < most:
        buckets *= 2
    bucket = F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets, 32).cast("int")
    rows = rows.withColumn("source_key", _source_key(F.col("source"))).withColumn("bucket", bucket)
    sums = rows.groupBy("source_key", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("words")
    starts = sums.select("source_key", "bucket", ahead.alias("ahead")).join(totals, "source_key")

    here = Window.partitionBy("source_key", "bucket").orderBy("place", "row", "size", "tie")
    whole = F.col("size") * F.col("copies")
    rows = rows.join(starts, ["source_key", "bucket"]).withColumn("ahead", F.col("ahead") + F.sum(whole).over(here) - whole)

    # copies told apart again, in blocks when they are many
    if (rows.agg(F.max("copies")).first()[0] or 0) > BLOCK:
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BLOCK).cast("long")))).repartition("place", "tie", "block")
        first, last = F.col("block") * BLOCK, F.least(F.col("copies"), (F.col("block") + 1) * BLOCK) - 1
    else:
        first, last = F.lit(0).cast("long"), F.col("copies") - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(first, last)))

    at = lambda repeat: repeat * F.col("source_size") + F.col("ahead") + F.col("copy") * F.col("size")
    part = lambda repeat: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - at(repeat)))

    def position(repeat: Column) -> Column:
        share = at(repeat) / F.col("quota").cast("double")
        when = F.lit(None).cast("double")
        for i, shape in enumerate(shapes):
            when = F.when(F.col("class") == i, reached(share, shape)).otherwise(when)
        return when

    repeats = F.sequence(F.lit(0).cast("long"), F.lit(limit - 1).cast("long"))
    takes = F.transform(F.filter(repeats, lambda r: part(r) > 0), lambda r: F.struct(r.cast("int").alias("repeat"), part(r).alias("words"), position(r).alias("position")))
    rows = rows.select("row", "size", "source_size", "target", "place", takes.alias("takes"))
    return rows.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t["words"]))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of a plan sorted by ranges of their first position; rows that are not taken come last."""
    rows = rows.withColumn("position", F.try_element_at("takes", F.lit(1))["position"])
    return rows.orderBy(F.col("position").asc_nulls_last(), "place")


def occurrences(rows: DataFrame) -> DataFrame:
    """The training order: one row for every occurrence (row, repeat, words, position), by position."""
    rows = rows.select("row", "place", F.explode("takes").alias("take")).select("row", "place", "take.*")
    return rows.orderBy("position", "place", "repeat").drop("place")


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3 of their sources, with at most three repeats."""
    rows = in_order(plan(table(spark, sf_dir, "documents")))
    return rows.select("row.doc_id", "size", "source_size", "target", "taken", "position")


# DuckDB: the level is found among the sources sorted by limit over weight, in one pass.
def _sql_reached(shape: Shape) -> str:
    pieces = scaled(shape)
    cases = []
    for i, (t0, length, height, slope, before) in enumerate(pieces):
        rest = f"(u - {before!r})"
        at = f"{t0!r} + CASE WHEN {rest} > 0 THEN least(2.0::DOUBLE * {rest} / ({height!r} + sqrt(greatest({height * height!r} + {2 * slope!r} * {rest}, 0.0))), {length!r}) ELSE 0.0 END"
        cases.append(f"WHEN u < {pieces[i + 1][4]!r} THEN {at}" if i + 1 < len(pieces) else f"ELSE {at}")
    return f"CASE {' '.join(cases)} END" if len(cases) > 1 else cases[0].removeprefix("ELSE ")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS class FROM d GROUP BY source),
w AS (SELECT *, (class + 1)::BIGINT AS weight FROM s),
c AS (SELECT *, coalesce(sum(size) OVER before, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before,
        (SELECT sum(size)::BIGINT FROM w) AS words, (SELECT sum(weight)::BIGINT FROM w) AS units FROM w
      WINDOW before AS (ORDER BY size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, {LIMIT} * size * (units - weight_before) < (words - {LIMIT} * size_before) * weight AS closed FROM c),
l AS (SELECT max(words) - {LIMIT} * coalesce(sum(CASE WHEN closed THEN size END), 0)::BIGINT AS words,
             max(units) - coalesce(sum(CASE WHEN closed THEN weight END), 0)::BIGINT AS units FROM k),
t AS (SELECT k.source, k.size AS source_size, k.class,
        CASE WHEN closed THEN ({LIMIT} * k.size)::DOUBLE ELSE (l.words * k.weight)::DOUBLE / l.units END AS target FROM k, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.class, floor(t.target + 0.5)::BIGINT AS quota,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, ahead::DOUBLE / quota AS u FROM r)
SELECT doc_id, size, source_size, target,
  ({" + ".join(f"greatest(0, least(size, quota - {i} * source_size - ahead))" for i in range(LIMIT))})::BIGINT AS taken,
  CASE WHEN size > 0 AND quota > ahead THEN CASE class {" ".join(f"WHEN {i} THEN {_sql_reached(s)}" for i, s in enumerate(SHAPES))} END END AS position
FROM x
"""
