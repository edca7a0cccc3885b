"""The tick job loses nothing, keeps nothing stale and repeats nothing."""

import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import scoring as SC
from hotzone.operators.alerts import rate_anomalies, tier_alerts
from hotzone.plans.catalog import fresh_feats
from hotzone.session import local_path, scratch_path
from hotzone.sources.events import read_table
from hotzone.streaming import stream as ST
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def parts(spark):
    """Files out of order: the middle third of the ids last, with every seventh
    id of the first file again, a day later; then a file of repeats only."""
    ev = read_table(spark, SMALL, "events")
    e = F.col("event_id")
    first, late = ev.filter(e < 330), ev.filter((e >= 330) & (e < 660))
    again = first.filter(e % 7 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    src = scratch_path(spark, "parts")
    for p in (first, ev.filter(e >= 660), late.unionByName(again), first.filter(e % 2 == 0)):
        p.coalesce(1).write.mode("append").parquet(src)
    return src


@pytest.fixture(scope="module")
def meta(spark):
    return SC.zone_meta(AG.zone_stats(fresh_feats(spark, SMALL))).checkpoint()


def test_failed_steps_are_run_again_and_late_files_leave_nothing_stale(spark, parts, meta, monkeypatch):
    feats = fresh_feats(spark, SMALL)
    base = AG.rate_baseline(feats).checkpoint()
    folder, calls = scratch_path(spark, "job"), {"n": 0}
    whole = ST.score_ticks

    def fails_once(*a, **k):
        calls["n"] += 1
        if calls["n"] == 2:
            raise RuntimeError("transient")
        return whole(*a, **k)

    monkeypatch.setattr(ST, "score_ticks", fails_once)
    go = lambda: ST.run_ticks(ST.stream_events(spark, parts, 1), folder, 7, meta=meta, baseline=base).awaitTermination()
    with pytest.raises(StreamingQueryException):
        go()
    go()
    assert not ST._stored(spark, f"{folder}/errors")
    log = ST.read_log(spark, folder)
    assert log.count() == log.select("id").distinct().count() == feats.count()
    # repeats only: nothing was scored for the last batch (one failure, three batches with new rows)
    assert calls["n"] == 4
    assert sorted(os.listdir(local_path(f"{folder}/rescored/alerts")))[-1] == "batch_id=2"
    # the stored tables are those of the stored scores, and these those of the whole log
    scores = ST.read_scores(spark, folder)
    lo, hi = feats.agg(F.min("created_datetime").cast("timestamp_ntz"), F.max("created_datetime").cast("timestamp_ntz")).first()
    want = whole(spark, log, ST._midnights(lo, hi), 7, meta=meta)
    cols = ["cluster", "recalculated_at", "violation_count", "congestion_score", "risk_tier"]
    assert sorted(map(tuple, scores.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    key = ["id", "cluster", "new_tier", "triggered_at"]
    assert sorted(map(tuple, ST.read_alerts(spark, folder).select(*key).collect())) == sorted(map(tuple, tier_alerts(scores).select(*key).collect()))
    key = ["id", "cluster", "severity", "detected_at"]
    assert sorted(map(tuple, ST.read_anomalies(spark, folder).select(*key).collect())) == sorted(map(tuple, rate_anomalies(scores, base).select(*key).collect()))


def test_ticks_below_a_day_and_retention(spark, meta):
    ev = read_table(spark, SMALL, "events").filter(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"))
    src, folder = scratch_path(spark, "src"), scratch_path(spark, "job")
    ev.coalesce(1).write.parquet(src)
    ST.run_ticks(ST.stream_events(spark, src, 1), folder, 1, meta=meta, ticks_per_day=4, keep=dt.timedelta(days=1)).awaitTermination()
    got = [r[0] for r in ST.read_scores(spark, folder).select(F.col("recalculated_at").cast("timestamp_ntz")).distinct().collect()]
    assert max(got) - min(got) <= dt.timedelta(days=1) and len(got) >= 4
    assert {t.hour for t in got} <= {0, 6, 12, 18} and len({t.hour for t in got}) > 1


def key_rows(df, key):
    return sorted(map(tuple, df.select(*key).collect()))


def test_later_steps_that_fail_are_made_up_for(spark, parts, meta, monkeypatch):
    """Alerts fail twice in the first batch, anomalies in the second: the ledger
    carries their ticks to the next batch, also to one of repeats only."""
    from hotzone.operators import alerts as AL
    from hotzone.operators.forecast import train_forecast, validate, validation_candidates

    feats = fresh_feats(spark, SMALL)
    base = AG.rate_baseline(feats).checkpoint()
    folder, fail = scratch_path(spark, "job"), {"tier_alerts": [1, 2], "rate_anomalies": [5, 6]}
    calls = dict.fromkeys(fail, 0)

    def failing(name, whole):
        def run(*a, **k):
            calls[name] += 1
            if calls[name] in fail[name]:
                raise RuntimeError("transient")
            return whole(*a, **k)
        return run

    for name in fail:
        monkeypatch.setattr(AL, name, failing(name, getattr(AL, name)))
    fm = train_forecast(feats, use_model=False)
    ST.run_ticks(ST.stream_events(spark, parts, 1), folder, 7, meta=meta, baseline=base, forecaster=fm).awaitTermination()
    monkeypatch.undo()
    errors = spark.read.parquet(f"{folder}/errors").select("batch_id", "step").collect()
    assert [tuple(e) for e in errors] == [(0, "alerts")] or len(errors) == 2
    last = spark.read.schema(ST.LEDGER).parquet(f"{folder}/ledger")
    assert last.filter("state = 'failed'").count() == len(errors)
    scores = ST.read_scores(spark, folder)
    key = ["id", "cluster", "new_tier", "triggered_at"]
    assert key_rows(ST.read_alerts(spark, folder), key) == key_rows(tier_alerts(scores), key)
    key = ["id", "cluster", "severity", "detected_at"]
    assert key_rows(ST.read_anomalies(spark, folder), key) == key_rows(rate_anomalies(scores, base), key)
    fc = ST.read_forecasts(spark, folder)
    newest = scores.agg(F.max("recalculated_at")).first()[0]
    assert {r[0] for r in fc.select("forecast_at").distinct().collect()} == {newest}
    key = ["cluster", "forecast_at", "hour_offset", "validation_status"]
    want = validate(validation_candidates(fc, scores))
    assert key_rows(ST.read_validations(spark, folder).filter(F.col("forecast_at") == F.lit(newest)), key) == key_rows(want, key)


def test_exact_dedupe_reads_a_batch_s_own_ids(spark):
    """50 files of 40 rows, each with ten ids of the file before and ten of the
    first: a batch looks up its rows' ids and adds the new ones, however many are stored."""
    src, folder = scratch_path(spark, "src"), scratch_path(spark, "dedupe")
    schema = "id long, created_datetime timestamp"
    at = dt.datetime(2024, 1, 1)
    for k in range(50):
        ids = [*range(20 * k, 20 * k + 20), *range(max(0, 20 * k - 10), 20 * k), *range(10)]
        spark.createDataFrame([(i, at - dt.timedelta(days=k)) for i in ids], schema).coalesce(1).write.mode("append").parquet(src)
    s = ST.dedupe(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), None)
    seen = []
    q = (s.writeStream.foreachBatch(lambda df, b: seen.append([r.id for r in df.select("id").collect()]))
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    assert [len(b) for b in seen if b] == [20] * 50 and sorted(i for b in seen for i in b) == list(range(1000))
    ops = [(p["numInputRows"], p["stateOperators"][0]) for p in q.recentProgress if p["numInputRows"]]
    assert len(ops) == 50 and all(n <= 40 and o["numRowsUpdated"] == 20 for n, o in ops)
    assert "RocksDB" in str(ops[-1][1]["customMetrics"].keys()) or any("rocksdb" in m for m in ops[-1][1]["customMetrics"])


def test_affected_ticks():
    d, day = dt.datetime(2024, 1, 10), dt.timedelta(days=1)
    at = [dt.timedelta(0)]
    # new rows on the 10th, log so far from the 1st to the 20th: the windows that hold the 10th
    assert ST.affected_ticks([d.date()], dt.datetime(2024, 1, 20, 5), dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 20, 5), 3, at) == [d + k * day for k in (1, 2, 3)]
    # the log grew from the 10th to the 12th: the ticks in between as well
    got = ST.affected_ticks([dt.date(2024, 1, 12)], dt.datetime(2024, 1, 10, 5), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 12, 9), 3, at)
    assert got == [dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 12)]
    # one stray old row adds its own window's ticks only
    got = ST.affected_ticks([dt.date(1970, 1, 1)], dt.datetime(2024, 1, 10), dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 10), 2, at)
    assert got == [dt.datetime(1970, 1, 2), dt.datetime(1970, 1, 3)]
