"""Session helpers: a configured SparkSession and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: HotSpot interprets methods of more bytecode than this for good; Spark then generates smaller ones, an operator at a time.
COMPILED_BYTES = 8000
#: Rows go to Python in batches of so many bytes at most: the default of 64 MB is held several times over by every task.
ARROW_BATCH = "8m"
#: The same for jobs that handle text by text in Python: the JVM holds a task's batches several times over, off its heap.
TEXT_BATCH = "1m"


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hotzone") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the cluster's builder.

    AQE is on (runtime coalescing, skew-join splitting, runtime broadcast),
    the session time zone is UTC and the web UI stays off.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Settings every job relies on: UTC times, AQE with skew splitting, no
    generated method that the JVM leaves uncompiled, small batches to Python, and
    a reliable checkpoint folder. Safe to call on any running session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    ensure_checkpoint_dir(spark)


def configure_texts(spark: SparkSession) -> None:
    """``configure`` for jobs whose Python takes one text after the other, so that batches may be small."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may get its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="hotzone-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/hotzone-{name}-{uuid.uuid4().hex[:12]}"


def saved(df, name: str):
    """``df`` written to the shared folder and read back: a pruned, compressed
    cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python code can look at a local folder in tests."""
    return path[len("file:"):] if path.startswith("file:") else path


def exists(path: str) -> bool:
    return os.path.exists(local_path(path))
