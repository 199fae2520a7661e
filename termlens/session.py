"""Session helpers: a tuned local session for tests/bench and checkpoint-dir resolution.

On a cluster the session is created by the platform; the library never
overrides settings that are already present.  ``ensure_checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only falls back to a caller-given
folder when the cluster did not name one (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "termlens") -> SparkSession:
    """A local session with AQE on, UI off, UTC, Arrow on; for tests and bench only."""
    scratch = tempfile.mkdtemp(prefix="termlens-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TERMLENS_DRIVER_MEMORY", "8g"))
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, fallback=os.path.join(scratch, "checkpoints"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the reliable checkpoint folder, setting it from the session conf if needed.

    Order: an already-set SparkContext checkpoint dir, then ``spark.checkpoint.dir``
    from the session conf (the shared folder a cluster names), then ``fallback``
    (tests only).  Raises when none is available, rather than silently using a
    machine-local folder on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    target = conf_dir or fallback
    if not target:
        raise RuntimeError(
            "no checkpoint folder: set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) "
            "so lineage can be cut reliably"
        )
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back (columnar, compressed;
    a lost executor costs nothing, and what was written never changes when a task runs again)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that the library wrote, in whatever store holds it (nothing if it is gone)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
