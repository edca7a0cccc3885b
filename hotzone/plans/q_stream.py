"""Registered queries: streaming replay, dedupe, tick job, hourly counts and
stream-produced alerts (H1-H9). Each runs a Structured Streaming query with
``availableNow`` over the event table laid out as files, then reads the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import alerts as AL
from hotzone.operators import scoring as SC
from hotzone.operators.forecast import FORECAST_COLUMNS
from hotzone.operators.ranking import latest_global
from hotzone.oracles import r6, with_
from hotzone.plans.catalog import feats, out, register
from hotzone.plans.q_alerts import ANOM, ANOM_SELECT, BASELINE, ZS, alert_ctes
from hotzone.plans.q_forecast import FC_SELECT, HOURLY, grid_sql, history_model
from hotzone.plans.q_scoring import LIVE_D, LIVE_O
from hotzone.plans.q_views import CANDS, FC_LT
from hotzone.session import scratch_path
from hotzone.sources.events import read_table
from hotzone.streaming import stream as ST

FILES = 6
PART_FILES = 2  # of each part of the disordered replay: a batch reads one part
DELAY = "40 days"  # longer than the replay's disorder, so no row is late
_RUNS: dict = {}


def source(spark, sf, duplicates: bool = False):
    """The events table as FILES range files (plus, with ``duplicates``, every
    tenth event again in extra files written afterwards)."""
    key = ("src", sf, duplicates)
    if key not in _RUNS:
        ev = read_table(spark, sf, "events")
        folder = scratch_path(spark, "source")
        ST.write_source_files(ev, folder, FILES)
        if duplicates:
            ev.filter(F.col("event_id") % 10 == 0).repartitionByRange(2, "event_id") \
                .write.mode("append").option("parquet.block.size", ST.ROW_GROUP).parquet(folder)
        _RUNS[key] = folder
    return _RUNS[key]


def tick_run(spark, sf):
    key = ("ticks", sf)
    if key not in _RUNS:
        f = feats(spark, sf)
        meta = SC.zone_meta(AG.zone_stats(f)).checkpoint()
        base = AG.rate_baseline(f).checkpoint()
        folder = scratch_path(spark, "ticks")
        q = ST.run_ticks(ST.stream_events(spark, source(spark, sf, True), 1), folder, 7, meta=meta, baseline=base, forecaster=history_model(spark, sf))
        q.awaitTermination()
        _RUNS[key] = folder
    return _RUNS[key]


STREAM_TICKS = """SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS recalculated_at
  FROM (SELECT date_trunc('day', min(created_datetime)) + INTERVAL 1 DAY AS lo, max(created_datetime) AS hi
        FROM features)"""
SCTES = alert_ctes(STREAM_TICKS)


@register("stream_ingest", with_(*ZS) + "\nSELECT id, cluster, created_datetime, " + r6("impact") + " FROM features")
def q_stream_ingest(spark, sf):
    log = ST.read_log(spark, tick_run(spark, sf))
    return out(log.select("id", "cluster", "created_datetime", "impact"))


@register("stream_tick", with_(*SCTES) + "\nSELECT " + ", ".join(LIVE_O + [r6(c) for c in LIVE_D])
          + ", risk_tier, enforcement_shift FROM lt")
def q_stream_tick(spark, sf):
    sc = ST.read_scores(spark, tick_run(spark, sf))
    return out(sc.select(*LIVE_O, *LIVE_D, "risk_tier", "enforcement_shift"))


@register("stream_alerts", with_(*SCTES) + f"""
SELECT cluster, zone_name, police_station, previous_tier, new_tier, {r6('congestion_score')}, triggered_at, severity
FROM alerts""")
def q_stream_alerts(spark, sf):
    """The alert table the tick job wrote (per affected tick, overwritten on rescoring)."""
    return out(ST.read_alerts(spark, tick_run(spark, sf)).drop("id"))


@register("stream_anomalies", with_(*SCTES, BASELINE, ANOM) + "\n" + ANOM_SELECT)
def q_stream_anomalies(spark, sf):
    """The anomaly table of the tick job (stream-static join with the baseline)."""
    return out(ST.read_anomalies(spark, tick_run(spark, sf)).drop("id"))


# the newest midnight of the data is 30 January
TICK_FC = [*SCTES, HOURLY, grid_sql("2024-01-30 00:00:00")]


@register("tick_forecasts", with_(*TICK_FC) + "\n" + FC_SELECT.replace("fc_20240131", "fc_20240130"))
def q_tick_forecasts(spark, sf):
    """The forecast the tick job left: of its newest tick, from the history means."""
    return out(ST.read_forecasts(spark, tick_run(spark, sf)).select(*FORECAST_COLUMNS))


@register("tick_validations", with_(*TICK_FC, FC_LT, CANDS.replace("fc_20240131", "fc_20240130")) + """
SELECT cluster, forecast_at, hour_offset, validation_status FROM valid""")
def q_tick_validations(spark, sf):
    """The validations of the newest run (earlier runs keep theirs)."""
    return out(latest_global(ST.read_validations(spark, tick_run(spark, sf)), "forecast_at").select("cluster", "forecast_at", "hour_offset", "validation_status"))


def late_run(spark, sf):
    """The tick job over files out of order: the middle third of the ids comes
    last, and every seventh id of the first file comes again, a day later."""
    key = ("late", sf)
    if key not in _RUNS:
        f = feats(spark, sf)
        meta = SC.zone_meta(AG.zone_stats(f)).checkpoint()
        ev = read_table(spark, sf, "events")
        lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
        a, b = lo + (hi - lo) // 3, lo + 2 * (hi - lo) // 3
        folder = scratch_path(spark, "late")
        e = F.col("event_id")
        first = ev.filter(e < a)
        again = first.filter(e % 7 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
        for part in (first, ev.filter(e >= b), ev.filter((e >= a) & (e < b)).unionByName(again)):
            part.repartitionByRange(PART_FILES, "event_id").write.mode("append").option("parquet.block.size", ST.ROW_GROUP).parquet(f"{folder}/src")
        out_ = f"{folder}/out"
        ST.run_ticks(ST.stream_events(spark, f"{folder}/src", PART_FILES), out_, 7, meta=meta).awaitTermination()
        _RUNS[key] = out_
    return _RUNS[key]


@register("stream_late", with_(*SCTES) + f"""
SELECT cluster, zone_name, police_station, previous_tier, new_tier, {r6('congestion_score')}, triggered_at, severity
FROM alerts""")
def q_stream_late(spark, sf):
    """Alerts after late files and repeated ids: those of the whole log."""
    return out(ST.read_alerts(spark, late_run(spark, sf)).drop("id"))


@register("stream_dedupe", with_(*ZS) + "\nSELECT id, created_datetime FROM features")
def q_stream_dedupe(spark, sf):
    folder = scratch_path(spark, "dedupe")
    s = ST.dedupe(ST.stream_events(spark, source(spark, sf, True), 2), DELAY)
    q = (s.select("id", "created_datetime").writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out(spark.read.parquet(f"{folder}/out"))


@register("stream_hourly", with_(*ZS) + """
SELECT cluster, date_trunc('hour', created_datetime) AS hour_start, count(*) AS n FROM features
WHERE cluster <> -1 GROUP BY cluster, hour_start""")
def q_stream_hourly(spark, sf):
    folder = scratch_path(spark, "hourly")
    q = ST.stream_hourly(ST.stream_events(spark, source(spark, sf), 1), folder, DELAY)
    q.awaitTermination()
    return out(ST.read_hourly(spark, folder))
