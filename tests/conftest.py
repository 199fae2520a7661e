from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from termlens.session import ensure_checkpoint_dir

    scratch = tempfile.mkdtemp(prefix="termlens-tests-")
    s = (
        SparkSession.builder.master("local[*]")
        .appName("termlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "wh"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, fallback=os.path.join(scratch, "ckpt"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="termlens-t-")


@pytest.fixture(scope="session")
def d1(spark):
    """Six-row dataset: id, text, group, score."""
    rows = [
        (1, "I am happy and glad", "A", 5),
        (2, "I am sad and angry", "B", 2),
        (3, "happy happy joy", "A", 4),
        (4, "sad mad furious", "B", 1),
        (5, "glad glad happy", "A", 5),
        (6, "furious mad angry", "B", 1),
    ]
    return spark.createDataFrame(rows, "id bigint, text string, group string, score bigint")


@pytest.fixture(scope="session")
def w1(spark):
    from termlens.operators.vocabulary import vocabulary_from_entries

    return vocabulary_from_entries(spark, {"Affect": ["happy", "glad", "sad", "angry", "happ*"]}, namespace="wl1")


@pytest.fixture(scope="session")
def w2_wide(spark):
    rows = [
        ("happy", "X", None),
        ("sad", "X", None),
        ("happ*", "X", None),
        ("new york", None, "X"),
        ("new *", None, "X"),
    ]
    return spark.createDataFrame(rows, "DicTerm string, Affect string, Place string")
