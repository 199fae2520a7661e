"""The row-local analysis on a file stream equals the batch analysis (conversations)."""

from __future__ import annotations

import pytest

import os

from termlens.operators.analyze import analyze
from termlens.plans.catalog import TEST_WORDLIST
from termlens.operators.vocabulary import vocabulary_from_entries
from termlens.streaming.incremental import analyze_stream, read_document_stream, write_incremental


def test_stream_equals_batch(spark, tmpdir_path):
    sf = "/root/testdata/sf0.001"
    v = vocabulary_from_entries(spark, TEST_WORDLIST)
    stream = read_document_stream(spark, sf, glob="conversations.parquet", max_files_per_trigger=1)
    out = analyze_stream(stream, "text", v, enhanced=True)
    q = write_incremental(out, os.path.join(tmpdir_path, "data"), os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(tmpdir_path, "data"))
    from termlens.operators.enhance import enhance

    batch = enhance(spark.read.parquet(os.path.join(sf, "conversations.parquet")), "text", v)
    assert got.columns == batch.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_arrivals_with_a_large_dictionary(spark, tmpdir_path):
    """More entries than the row-local plan takes: the stream is refused there, and analysed batch by batch."""
    from termlens.errors import AnalysisConfigError
    from termlens.operators.analyze import analyze
    from termlens.operators.vocabulary import vocabulary_from_entries
    from termlens.streaming.incremental import analyze_arrivals, read_document_stream

    docs = spark.createDataFrame([(1, "happy sad"), (1, "sad"), (None, None)], "id int, text string")
    docs.write.parquet(f"{tmpdir_path}/in")
    v = vocabulary_from_entries(spark, {"a": ["happy", "sad", "sa*"]})
    stream = read_document_stream(spark, f"{tmpdir_path}/in")
    with pytest.raises(AnalysisConfigError):
        analyze(stream, "text", v, literal_threshold=2)
    analyze_arrivals(stream, "text", v, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", literal_threshold=2, with_detected=False).awaitTermination()
    got = spark.read.parquet(f"{tmpdir_path}/out").select("id", "a_word_count").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 3), (1, 2), (None, 0)], key=str)
