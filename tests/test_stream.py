"""The streaming tick job converges to the batch result for any split of the files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import scoring as SC
from hotzone.plans.catalog import fresh_feats
from hotzone.session import scratch_path
from hotzone.sources.events import read_table
from hotzone.streaming import stream as ST
from tests.conftest import SMALL

COLS = ["cluster", "recalculated_at", "violation_count", "active_days", "congestion_score", "risk_tier", "zone_name"]


@pytest.mark.parametrize("files,per_batch", [(3, 2), (5, 1)])
def test_stream_ticks_equal_batch_ticks(spark, files, per_batch):
    f = fresh_feats(spark, SMALL)
    meta = SC.zone_meta(AG.zone_stats(f)).checkpoint()
    src = ST.write_source_files(read_table(spark, SMALL, "events"), scratch_path(spark, "src"), files)
    folder = scratch_path(spark, "ticks")
    ST.run_ticks(ST.stream_events(spark, src, per_batch), folder, 7, meta=meta).awaitTermination()
    assert ST._read_or_none(spark, f"{folder}/errors") is None
    got = ST.read_scores(spark, folder).select(*COLS)
    lo, hi = f.agg(F.min("created_datetime").cast("timestamp_ntz"), F.max("created_datetime").cast("timestamp_ntz")).first()
    ticks = ST._midnights(lo, hi)
    exp = SC.score_ticks(spark, f.drop("date"), ticks, 7, meta=meta).select(*COLS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    assert got.select("recalculated_at").distinct().count() == len(ticks)


def test_late_rows_are_counted(spark):
    """Files written newest first: with a 1-hour watermark the older files
    arrive late; every input row is either kept or counted as dropped."""
    ev = read_table(spark, SMALL, "events")
    src = scratch_path(spark, "late")
    for lo, hi in ((700, 1000), (350, 700), (0, 350)):  # later time ranges are written (and read) first
        ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(src)
    out = scratch_path(spark, "late-out")
    s = ST.dedupe(ST.stream_events(spark, src, 1), "1 hour")
    q = (s.select("id").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    kept = spark.read.parquet(out).count()
    dropped = ST.dropped_by_watermark(q)
    expected = fresh_feats(spark, SMALL).count()
    assert dropped > 0
    assert kept + dropped == expected


def test_batch_writes_rows_of_a_date_together(spark):
    """A batch that holds every date leaves about a file per date, and its
    buckets, from which the ticks are scored, hold its rows once."""
    ev = read_table(spark, SMALL, "events")
    src = scratch_path(spark, "all-dates")
    for k in range(2):  # every file holds every date
        ev.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(src)
    f = fresh_feats(spark, SMALL)
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    folder = scratch_path(spark, "all-dates-out")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        ST.run_ticks(ST.stream_events(spark, src, 1), folder, 7).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    assert ST._read_or_none(spark, f"{folder}/errors") is None
    log = spark.read.parquet(f"{folder}/log")
    assert len(log.inputFiles()) <= 2 * log.select("batch_id", "date").distinct().count()
    kept = f.filter(F.col("cluster") != -1).groupBy("date").count()
    held = spark.read.parquet(f"{folder}/buckets").groupBy(F.to_date("_d").alias("date")).agg(F.sum("n_rows").alias("count"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, kept.collect()))
