"""The pipeline's stages on their own input, against what each must decide."""

from __future__ import annotations

import corpus_pipeline
from termlens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "packing"]
    bench = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r for r in after.collect()}
        if name == "decontamination":  # planted passages are exact
            assert set(before) - set(rows) == {d for d, r in before.items() if any(" ".join(b.split()) in " ".join((r["text"] or "").lower().split()) for b in bench)}
        if name == "near_duplicates":
            assert {r["text"] for r in rows.values()} >= {t for t in {r["text"] for r in before.values()} if sum(x["text"] == t for x in before.values()) > 1}
        if name == "secret_scan":
            assert set(rows) == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == set(rows)


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x", 1.0), (2, "", "en", "s", 0, "y", 2.0)], "doc_id long, text string, lang string, source string, n_chars long, toxicity string, component_id double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 2
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    assert len(QUERIES) == 13 and set(ORACLE_SQL) <= set(QUERIES)
