"""Exact top terms by a three-phase threshold algorithm (TOP-1/WIN-1 for very large vocabularies).

Every task counts its own terms; nothing but these local counts is kept, where they were made.  Then,
with m local tables and the wanted k terms of each category:

1. The sums of every table's own first k terms give a lower bound of the k-th total.
2. Terms with at least a m-th of that bound in some table are summed.  A term below it everywhere
   cannot be among the first k.  The sums raise the bound, and what a term may still have in the other
   tables bounds its total from above; terms that stay below the new bound are out.
3. The remaining candidates are counted exactly.

So only candidates are shuffled, however many different terms there are.  The rows are those of
:func:`termlens.operators.detected.top_terms_per_category`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlens.operators.detected import detected_categories, detected_long
from termlens.session import stage_table

HELD = 1_000_000  # different terms that a task counts at once
WAITING = 100_000  # rows that a task takes at least before it sums them
MEASURES = ("frequency", "doc_frequency")
_LOCAL = "site long, category string, term string, frequency long, doc_frequency long, place long"


def local_counts(long: DataFrame, by: str) -> DataFrame:
    """(site, category, term, frequency, doc_frequency, place): the counts of every task, written once.

    ``place`` ranks a site's terms of a category.  A task with more than ``HELD`` different terms makes
    several sites, so its memory is bounded.
    """
    names = ["category", "term"]

    def summed(tables: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(tables).group_by(names).aggregate([("frequency", "sum"), ("doc_frequency", "sum")])
        return got.rename_columns([c.removesuffix("_sum") for c in got.column_names]).select([*names, *MEASURES])

    def site(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([("category", "ascending"), (by, "descending"), ("term", "ascending")])
        category = table.column("category").combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.arange(len(category))
        first = np.maximum.accumulate(np.where(np.append(True, category[1:] != category[:-1])[: len(at)], at, 0))
        table = table.add_column(0, "site", pa.array(np.full(len(at), number), pa.int64())).append_column("place", pa.array(at - first + 1, pa.int64()))
        yield from table.combine_chunks().to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        new: list[pa.Table] = []
        waiting = 0
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            new.append(pa.table({"category": batch.column("category").cast(pa.string()), "term": batch.column("term").cast(pa.string()), "frequency": batch.column("occ"), "doc_frequency": pa.array(np.ones(batch.num_rows, np.int64))}))
            waiting += batch.num_rows
            # summed when as many rows wait as are held, so each row is summed a few times, however many there are
            if waiting >= max(WAITING, held.num_rows if held is not None else 0):
                held, new, waiting = summed(new if held is None else [held, *new]), [], 0
                if held.num_rows > HELD:
                    yield from site(held, number)
                    held, number = None, number + 1
        if waiting:
            held = summed(new if held is None else [held, *new])
        if held is not None and held.num_rows:
            yield from site(held, number)

    return stage_table(long.select("category", "term", "occ").mapInArrow(run, _LOCAL), "local-counts")


def kth_sum(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(category, name): the k-th largest sum ``s`` of each category that has k of them."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("s")))
    return sums.withColumn("__i", place).where(F.col("__i") <= k).groupBy("category").agg(F.when(F.count(F.lit(1)) == k, F.min("s")).alias(name))


def candidates(local: DataFrame, k: int, by: str) -> DataFrame:
    """(category, term) of every term that can be among the first ``k`` of its category."""
    sites = local.select("site").distinct().count()
    first = local.where(F.col("place") <= k).groupBy("category", "term").agg(F.sum(by).alias("s"))
    # one row for each category; without k terms at hand everything stays
    bound = kth_sum(first, k, "low").withColumn("least", F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("low"), F.lit(0)) / max(1, sites))))
    seen = local.join(bound.select("category", "least"), "category").where(F.col(by) >= F.col("least"))
    sums = seen.groupBy("category", "term", "least").agg(F.sum(by).alias("s"), F.count(F.lit(1)).alias("r"))
    sums = stage_table(sums, "partial-sums")
    high = kth_sum(sums, k, "high")
    may = F.col("s") + (F.lit(sites) - F.col("r")) * (F.col("least") - 1)
    return sums.join(high, "category").where(may >= F.coalesce(F.col("high"), F.lit(0))).select("category", "term")


def top_terms_by_threshold(df: DataFrame, top_n: int = 10, by: str = "frequency", categories: Sequence[str] | None = None) -> DataFrame:
    """Top-N terms of every category: ``category, rank, term, frequency, doc_frequency``."""
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    if by not in MEASURES:
        raise ValueError(f"by must be one of {MEASURES}")
    cats = list(categories) if categories is not None else detected_categories(df)
    local = local_counts(detected_long(df.withColumn("__row", F.lit(0)), ["__row"], cats), by)
    exact = local.join(candidates(local, top_n, by), ["category", "term"]).groupBy("category", "term")
    exact = exact.agg(*[F.sum(m).cast("bigint").alias(m) for m in MEASURES])
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc(by), F.asc("term")))
    return exact.withColumn("rank", place).where(F.col("rank") <= top_n).select("category", "rank", "term", *MEASURES)
