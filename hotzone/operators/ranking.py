"""Ranking, latest-row and limit operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols) -> list[Column]:
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
        elif c.startswith("-"):
            out.append(F.col(c[1:]).desc())
        else:
            out.append(F.col(c).asc())
    return out


def ordinal(df: DataFrame, order: list, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """1, 2, ... in ``order`` over the whole table without a single-task window.

    Rows are range-partitioned on the order (partition i holds smaller keys
    than partition i+1) and written once to the shared folder: the bounds are
    sampled while that runs, so the numbering and the partitions' row counts
    must come from the one written copy. Rows are numbered within their
    partition and shifted by the row count of the partitions before it (one
    small row per partition). The order must be total (add a key) for the
    numbers to be repeatable.
    """
    from hotzone.session import scratch_path

    o = _order(order)
    spark = df.sparkSession
    n = partitions or spark.sparkContext.defaultParallelism
    path = scratch_path(spark, "ordinal")
    df.repartitionByRange(n, *o).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    r = spark.read.parquet(path)
    local = r.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*o)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_pid", (F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                            .alias("_off"))  # one row per partition
    out = local.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn")).cast("long"))
    return out.drop("_pid", "_rn", "_off")


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows by ``order`` (``-col`` = descending); add a key to the order
    for determinism (E3). Planned as TakeOrderedAndProject: n rows per task."""
    return df.orderBy(*_order(order)).limit(n)


def top_n_per_group(df: DataFrame, by: list[str], order: list, n: int, salt_buckets: int = 32,
                    salt_col: str | None = None) -> DataFrame:
    """First n rows per group (E4), exact and skew-safe.

    Phase 1 keeps the first n rows within (group, salt), so a group holding a
    third of all rows is ranked by ``salt_buckets`` tasks; phase 2 ranks the at
    most ``n * salt_buckets`` survivors per group. ``salt_col`` defaults to a
    hash of all columns. ``salt_buckets=1`` is for groups with a known bound
    (e.g. one row per zone and tick): a single window.
    """
    o = _order(order)
    if salt_buckets <= 1:  # groups known to be bounded: one window
        w = Window.partitionBy(*by).orderBy(*o)
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    salt = F.pmod(F.hash(F.col(salt_col)) if salt_col else F.hash(*[F.col(c) for c in df.columns]),
                  F.lit(salt_buckets))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*o)
    pre = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n)
    w2 = Window.partitionBy(*by).orderBy(*o)
    return (pre.drop("_rn", "_salt").withColumn("rank", F.row_number().over(w2))
            .filter(F.col("rank") <= n))


def latest_global(df: DataFrame, ts: str) -> DataFrame:
    """Rows at the newest value of ``ts`` over the whole table (C13): a one-row
    max aggregate joined back by broadcast (a semi join on one value)."""
    newest = df.agg(F.max(ts).alias(ts))
    return df.join(F.broadcast(newest), on=ts, how="left_semi")


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows at the newest ``ts`` of their key, ties kept (C14). A per-key max
    aggregate (map-side combined) joined back on (key, ts)."""
    newest = df.groupBy(key).agg(F.max(ts).alias(ts))
    return df.join(newest, on=[key, ts], how="left_semi")


def recent_events(log: DataFrame, hours: int, limit: int | None, ts: str = "ingested_at",
                  key: str = "id", date: str = "date") -> DataFrame:
    """Rows of the last ``hours`` before the newest row, newest first, at most
    ``limit`` (E6). ``limit`` is the feature of the view, not a cost cap.

    A log partitioned by ``date`` of ``ts`` is read for its newest dates only:
    the newest date and time are looked up first (two one-row results), and the
    filter on them is a literal that prunes partitions and row groups.
    """
    newest = log
    if date in log.columns:
        last = log.agg(F.max(date)).first()[0]
        newest = log.filter(F.col(date) == F.lit(last)) if last is not None else log
    at = newest.agg((F.max(ts) - F.make_interval(hours=F.lit(hours))).alias("from")).first()["from"]
    rows = log.filter(F.col(ts) >= F.lit(at)) if at is not None else log.filter(F.lit(False))
    if date in log.columns and at is not None:
        rows = rows.filter(F.col(date) >= F.lit(at).cast("date"))
    return top_n(rows, [f"-{ts}", f"-{key}"], limit) if limit is not None else rows


def next_batch(df: DataFrame, position_ts, position_id, n: int, ts: str = "created_datetime",
               key: str = "id", date: str = "date") -> DataFrame:
    """The next n rows after the (time, id) position, in time order (E7); a
    table partitioned by ``date`` is read from the position's date on."""
    from hotzone.functions.scalar import ts_lit

    p = ts_lit(position_ts)
    if date in df.columns:
        df = df.filter(F.col(date) >= p.cast("date"))
    after = (F.col(ts) > p) | ((F.col(ts) == p) & (F.col(key) > F.lit(position_id)))
    return top_n(df.filter(after), [ts, key], n)
