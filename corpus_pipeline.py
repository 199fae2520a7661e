"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents.  All stages but the last keep the columns of ``documents``:
toxicity drops the documents with a score of at least 0.5, near-duplicate removal keeps one document
of each group, decontamination drops documents that hold a benchmark item, the secret scan replaces
secrets in the text (and sets ``n_chars`` anew), and packing returns the pieces of the sequences.

Defined results: empty tables pass through; null and empty texts stay (they are neither toxic nor
copies of one another) and pack to the end id; extra columns are carried along; rows are judged one by
one, so rows that share an id but not a text all stay, and copies without an id go; texts of any length
are processed whole; see the operators for ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import keep, table
from termlens.llm.op01_secret_scan import redact
from termlens.llm.op02_decontaminate import clean
from termlens.llm.op06_toxicity import learnable, rate, train
from termlens.llm.op07_minhash import deduplicate
from termlens.llm.op08_packing import pack

THRESHOLD = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 (operator 6)."""
    examples = train(docs, table(spark, sf_dir, "labels"), learnable())
    return rate(docs, examples, out="__toxicity").where(F.col("__toxicity.score") < THRESHOLD).drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 or more (operator 7)."""
    return deduplicate(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark item (operator 2)."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced (operator 1)."""
    rows = redact(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of at most 2048 tokens (operator 8)."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# No SQL: nearest labelled examples, minhash components, alignment and retrieval are not expressible.
# The tests hold near_duplicates, decontamination, secret_scan and the pieces of packing against
# brute-force versions of their operators, and toxicity's search against all cosines.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
