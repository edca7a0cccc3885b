"""Table sinks and log maintenance.

Tables are Parquet folders. Appends are idempotent: each write goes to its
own ``batch_id`` partition with dynamic partition overwrite, so a replayed
micro-batch replaces what it wrote before instead of adding it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def seed(df: DataFrame, days: int | None = None, ts: str = "created_datetime") -> DataFrame:
    """Rows of the first ``days`` days after the earliest row (all rows when
    None), with ``ingested_at = created`` (A5). The earliest time is a one-row
    aggregate joined back by broadcast."""
    out = df.filter(F.col(ts).isNotNull())
    if days is not None:
        from hotzone.operators.util import with_one_row

        first = out.agg(F.min(ts).alias("_first"))
        out = (with_one_row(out, first)
               .filter(F.col(ts) <= F.col("_first") + F.make_interval(days=F.lit(days)))
               .drop("_first"))
    return out.withColumn("ingested_at", F.col(ts))


def insert_new(batch: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``target``, one per key (A6):
    ``dropDuplicates`` within the batch, then a left anti join on the key."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def append(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Append ``df`` as batch ``batch_id`` (A7); writing the same batch again
    replaces it (dynamic partition overwrite on ``batch_id``)."""
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *(partition_by or [])).parquet(path))


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def latest_run(df: DataFrame, ts: str = "forecast_at") -> DataFrame:
    """Rows of the newest run only."""
    from hotzone.operators.ranking import latest_global

    return latest_global(df, ts)


def write_outputs(zones: DataFrame, top: DataFrame, features: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The three preprocess outputs (A10): zone table, top zones, feature rows
    (features partitioned by date)."""
    w = lambda d: d.write.mode("overwrite")
    if fmt == "csv":
        w(zones).option("header", True).csv(f"{folder}/cluster_stats")
        w(top).option("header", True).csv(f"{folder}/top_zones")
        w(features.drop("labels")).option("header", True).partitionBy("date").csv(f"{folder}/features")
    else:
        w(zones).parquet(f"{folder}/cluster_stats")
        w(top).parquet(f"{folder}/top_zones")
        w(features).partitionBy("date").parquet(f"{folder}/features")


def write_snapshot(views: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each view as a JSON folder (A11), written by the executors; no HTTP."""
    paths = {}
    for name, df in views.items():
        p = f"{folder}/{name}"
        df.write.mode("overwrite").json(p)
        paths[name] = p
    return paths


def apply_acks(log: DataFrame, acks: DataFrame, key: str = "id") -> DataFrame:
    """``acknowledged`` (0/1) from an append-only acknowledgement log (A12):
    left join on the key, at most one ack row per key."""
    a = acks.select(key).distinct().withColumn("_acked", F.lit(1))
    return (log.join(a, key, "left")
            .withColumn("acknowledged", F.coalesce(F.col("_acked"), F.lit(0))).drop("_acked"))
