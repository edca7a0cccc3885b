"""Registry of named queries (Spark) and their oracle SQL (DuckDB).

Every registered query reads the test tables under ``sf_dir`` (through the
``events`` -> raw violation mapping) and runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from hotzone.operators.features import build_features, with_given_zones
from hotzone.operators.util import round_doubles
from hotzone.oracles import DEVICE_T
from hotzone.sources.events import violations_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def out(df: DataFrame, places: int = 6) -> DataFrame:
    """Comparable output: doubles rounded half-even, timestamps without zone."""
    df = round_doubles(df, places)
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations_raw(spark, sf_dir)


_STORE: dict = {}


def stored(spark: SparkSession, key: tuple, build: Callable[[], DataFrame],
           partition_by: list[str] | None = None) -> DataFrame:
    """A derived table written once per application as Parquet in the shared
    folder (the pipeline's stored tables: feature rows by date, score
    history); later queries read it with column pruning, pushed filters and
    partition pruning instead of recomputing it."""
    k = (spark.sparkContext.applicationId,) + key
    if k not in _STORE:
        from hotzone.session import scratch_path

        path = scratch_path(spark, str(key[0]))
        w = build().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        _STORE[k] = path
    return spark.read.parquet(_STORE[k])


def memo(spark: SparkSession, key: tuple, build: Callable[[], object]) -> object:
    """An object (e.g. a fitted model) built once per application."""
    k = (spark.sparkContext.applicationId,) + key
    if k not in _STORE:
        _STORE[k] = build()
    return _STORE[k]


def fresh_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows computed from the raw events, with the generator's zones as
    clusters (device threshold 60)."""
    return with_given_zones(build_features(raw(spark, sf_dir), device_threshold=DEVICE_T))


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feature table (built once from the raw events)."""
    return stored(spark, ("features", sf_dir), lambda: fresh_feats(spark, sf_dir), ["date"])
