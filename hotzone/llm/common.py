"""Shared helpers of the training-data operators."""

from __future__ import annotations

import functools
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotzone.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module_name: str) -> None:
    """Send a module's functions to the executors by value, so they need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is exact when every character is one byte."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_key(c: Column) -> Column:
    """128-bit key of a text's content (null counts as empty).

    Rows with equal texts get equal results from every text operator here, so
    intermediate results are keyed by content: repeated or null document ids
    then need no special case, and copies collapse before a shuffle.
    """
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that clash with none of ``df``'s columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"_{w}"
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and is read
    with column pruning. The folder is removed when the application ends, or
    earlier by ``drop``. ``free`` removes the job's shuffle files once it is
    written instead of when the driver's garbage collector meets them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    if free:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    _path(spark, path)[0].deleteOnExit(_path(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned, when nothing reads them any more."""
    for t in tables:
        fs, path = _path(t.sparkSession, t.scratch)
        fs.delete(path, True)


def _path(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``node, comp`` (smallest node reachable) for every node with an edge.

    Alternates large-star and small-star contraction: every node is linked to
    the smallest of its neighbours until each component is a star around its
    smallest node. A round is two hash aggregations and two joins over the
    edges left, written to the shared folder; hubs are combined map-side and
    joined by a splittable join, so no node's neighbours meet in one task.
    Ends when a round leaves the edge set unchanged (no cap on rounds).
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    e = written(e, "cc")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())

    last = mark(e)
    while last[0]:
        und = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        m = und.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (und.filter("v > u").join(m, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        m2 = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.withColumnRenamed("hi", "u").join(m2, "u")
        nxt = (small.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
               .unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
               .filter("lo < hi").distinct())
        e = written(nxt, "cc")
        now = mark(e)
        if now == last:
            break
        last = now
    # converged: every edge joins a component's smallest node to another member
    return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("comp")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; it first applies the library's session settings."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            from hotzone.session import configure

            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco
