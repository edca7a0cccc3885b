"""Registered queries: serving views, table sinks, acknowledgements, latest
rows, validation candidates (A5-A7, A10-A12, B29, B32, C13, C14, C16, C17,
D14, D15, E6, E7, V1-V10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hotzone.functions import scalar as S
from hotzone.operators import aggregates as AG
from hotzone.operators import alerts as AL
from hotzone.operators import ranking as RK
from hotzone.operators import scoring as SC
from hotzone.operators.forecast import validate, validation_candidates
from hotzone.oracles import r6, with_
from hotzone.plans import views as V
from hotzone.plans.catalog import QUERIES, SQL, feats, out, register, stored
from hotzone.plans.q_alerts import ALERT_CTES, BASELINE, ZS, history_ctes
from hotzone.plans.q_forecast import HOURLY, grid_sql, history_forecast
from hotzone.plans.q_scoring import TICKS
from hotzone.session import scratch_path
from hotzone.sources import tables as T

# --- shared inputs -------------------------------------------------------------


def history(spark, sf, days):
    from hotzone.plans.q_alerts import history as stored_history

    return stored_history(spark, sf, days)


def alerts_table(spark, sf):
    """The stored alert table with its acknowledgements."""
    a = stored(spark, ("alerts", sf), lambda: AL.tier_alerts(history(spark, sf, 7)))
    return T.apply_acks(a, a.filter(F.col("severity") == "resolved").select("id"))


def anomalies_table(spark, sf):
    an = stored(spark, ("anomalies", sf), lambda: AL.rate_anomalies(history(spark, sf, 1), AG.rate_baseline(feats(spark, sf))))
    return T.apply_acks(an, an.filter(F.col("severity") == "moderate").select("id"))


def log_table(spark, sf):
    return T.seed(feats(spark, sf))


ALERTS_ACKED = """alerts_acked AS (SELECT *, CASE WHEN severity = 'resolved' THEN 1 ELSE 0 END AS acknowledged
  FROM alerts)"""
ANOM_D = [c for c in history_ctes(1, "_d")[len(ZS):]] + [BASELINE, """anom_d AS (
  SELECT l.*, b.baseline_mean, (l.daily_rate - b.baseline_mean) / greatest(b.baseline_std, 0.5e0) AS z
  FROM lt_d l JOIN baseline b USING (cluster)),
anoms AS (
  SELECT cluster, coalesce(zone_name, 'Unknown') AS zone_name, coalesce(police_station, 'Unknown') AS police_station,
    daily_rate AS current_rate, baseline_mean AS baseline_rate, round_even(z * 100e0, 0) / 100e0 AS z_score,
    CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS anomaly_type,
    CASE WHEN abs(z) >= 4.5e0 THEN 'extreme' WHEN abs(z) >= 3e0 THEN 'severe' ELSE 'moderate' END AS severity,
    recalculated_at AS detected_at, CASE WHEN abs(z) < 3e0 THEN 1 ELSE 0 END AS acknowledged
  FROM anom_d WHERE abs(z) >= 2e0)"""]
ALL = ALERT_CTES + [ALERTS_ACKED] + ANOM_D


@register("kpis", with_(*ALL) + """
SELECT
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt)) AS active_clusters,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'CRITICAL') AS critical_zones,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'HIGH') AS high_zones,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'MEDIUM') AS medium_zones,
  (SELECT count(*) FROM alerts_acked WHERE acknowledged = 0) AS unacked_alerts,
  (SELECT count(*) FROM anoms WHERE acknowledged = 0) AS anomalies,
  (SELECT count(*) FROM features) AS total_ingested,
  (SELECT strftime(max(created_datetime), '%Y-%m-%d %H:%M:%S') FROM features) AS last_ingested""")
def q_kpis(spark, sf):
    h7 = history(spark, sf, 7)
    return V.kpis(h7, alerts_table(spark, sf), anomalies_table(spark, sf), log_table(spark, sf))


ZV = ["cluster", "zone_name", "risk_tier", "violation_count", "enforcement_shift", "police_station"]
ZVD = ["congestion_score", "daily_rate", "blockage_pct", "lat", "lon"]
LATEST_PER_CLUSTER = """zlatest AS (
  SELECT l.*, z.lat, z.lon FROM lt l LEFT JOIN zones_named z USING (cluster)
  WHERE (l.cluster, l.recalculated_at) IN (SELECT cluster, max(recalculated_at) FROM lt GROUP BY cluster))"""


@register("zones", with_(*ALERT_CTES, LATEST_PER_CLUSTER) + "\nSELECT " + ", ".join(
    [f"zlatest.{c}" if c in ("cluster", "zone_name", "police_station") else c for c in ZV]
    + [r6(c) for c in ZVD]) + " FROM zlatest WHERE lat IS NOT NULL AND lon IS NOT NULL")
def q_zones(spark, sf):
    f = feats(spark, sf)
    return out(V.zones_view(history(spark, sf, 7), AG.zone_stats(f)).select(*ZV, *ZVD))


@register("zone_table", with_(*ALERT_CTES, LATEST_PER_CLUSTER) + "\nSELECT cluster, zone_name, police_station, "
          "risk_tier, violation_count, enforcement_shift, " + ", ".join(r6(c) for c in ZVD[:3])
          + " FROM zlatest WHERE lat IS NOT NULL ORDER BY congestion_score DESC, cluster LIMIT 20")
def q_zone_table(spark, sf):
    f = feats(spark, sf)
    return out(V.zone_table(history(spark, sf, 7), AG.zone_stats(f)))


RECENT = """recent AS (SELECT * FROM features
  WHERE created_datetime >= (SELECT max(created_datetime) FROM features) - INTERVAL 24 HOUR
  ORDER BY created_datetime DESC, id DESC LIMIT 80000)"""


@register("heat_volume", with_(*ZS, RECENT) + "\nSELECT " + r6("latitude") + ", " + r6("longitude")
          + ", 1.0e0 AS weight FROM recent")
def q_heat_volume(spark, sf):
    return out(V.heat_points(log_table(spark, sf), 24, "volume"))


@register("heat_impact", with_(*ZS, RECENT) + "\nSELECT " + r6("latitude") + ", " + r6("longitude")
          + ", " + r6("pow(impact, 2e0)", "weight") + " FROM recent WHERE impact >= 4e0")
def q_heat_impact(spark, sf):
    return out(V.heat_points(log_table(spark, sf), 24, "impact"))


@register("alerts_view", with_(*ALERT_CTES, ALERTS_ACKED) + f"""
SELECT cluster, zone_name, police_station, previous_tier, new_tier, {r6('congestion_score')}, triggered_at, acknowledged
FROM alerts_acked ORDER BY triggered_at DESC, cluster, previous_tier LIMIT 20""")
def q_alerts_view(spark, sf):
    v = V.alerts_view(alerts_table(spark, sf), 20)
    return out(v.select("cluster", "zone_name", "police_station", "previous_tier", "new_tier", "congestion_score",
                        "triggered_at", "acknowledged"))


@register("apply_acks", with_(*ALERT_CTES, ALERTS_ACKED) + """
SELECT cluster, triggered_at, previous_tier, new_tier, acknowledged FROM alerts_acked""")
def q_apply_acks(spark, sf):
    return out(alerts_table(spark, sf).select("cluster", "triggered_at", "previous_tier", "new_tier", "acknowledged"))


@register("anomalies_view", with_(*ZS, *ANOM_D) + f"""
SELECT cluster, zone_name, police_station, {r6('current_rate')}, {r6('baseline_rate')}, {r6('z_score')},
  anomaly_type, severity, detected_at
FROM anoms WHERE acknowledged = 0 ORDER BY z_score DESC, cluster, detected_at LIMIT 15""")
def q_anomalies_view(spark, sf):
    return out(V.anomalies_view(anomalies_table(spark, sf), 15).drop("id", "acknowledged"))


# --- forecasts, validations, deployment -------------------------------------------

FC = ZS[:1] + ZS[1:] + [HOURLY, grid_sql("2024-01-31 00:00:00")]
FC_LT = """lt_fc AS (SELECT cluster, daily_rate, congestion_score FROM lt
  WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt))"""
CANDS = """cands AS (
  SELECT f.cluster, f.forecast_at, f.hour_offset, f.target_datetime, f.predicted_violations, f.zone_name,
    f.police_station, s.daily_rate, s.congestion_score
  FROM fc_20240131 f LEFT JOIN lt_fc s USING (cluster)
  WHERE f.hour_offset = 1 ORDER BY f.predicted_violations DESC, f.cluster LIMIT 3),
valid AS (
  SELECT cluster, forecast_at, hour_offset,
    CASE WHEN predicted_violations > daily_rate * 0.5e0 AND congestion_score < 90e0 THEN 'Suspect' ELSE 'Valid' END
      AS validation_status FROM cands)"""


def forecasts(spark, sf):
    return history_forecast(spark, sf).checkpoint()


def candidates(spark, sf, fc=None):
    fc = fc if fc is not None else forecasts(spark, sf)
    h7 = history(spark, sf, 7)
    return validation_candidates(fc, h7, 3)


@register("validation_candidates", with_(*ALERT_CTES, *FC[2:], FC_LT, CANDS) + f"""
SELECT cluster, forecast_at, hour_offset, {r6('predicted_violations')}, {r6('daily_rate')},
  {r6('congestion_score')} FROM cands""")
def q_validation_candidates(spark, sf):
    c = candidates(spark, sf)
    return out(c.select("cluster", "forecast_at", "hour_offset", "predicted_violations", "daily_rate",
                        "congestion_score"))


@register("plausibility", with_(*ALERT_CTES, *FC[2:], FC_LT, CANDS) + """
SELECT cluster, forecast_at, hour_offset, validation_status FROM valid""")
def q_plausibility(spark, sf):
    return out(validate(candidates(spark, sf)).drop("llm_rationale"))


@register("not_validated", with_(*ALERT_CTES, *FC[2:], FC_LT, CANDS) + """,
done AS (SELECT * FROM cands ORDER BY predicted_violations DESC, cluster LIMIT 1)
SELECT c.cluster, c.forecast_at, c.hour_offset FROM cands c
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.cluster = c.cluster AND d.forecast_at = c.forecast_at
                  AND d.hour_offset = c.hour_offset)""")
def q_not_validated(spark, sf):
    c = candidates(spark, sf).checkpoint()
    done = validate(RK.top_n(c, ["-predicted_violations", "cluster"], 1))
    keys = ["cluster", "forecast_at", "hour_offset"]
    return out(c.join(done.select(*keys), keys, "left_anti").select(*keys))


@register("forecasts_view", with_(*ALERT_CTES, *FC[2:], FC_LT, CANDS) + f"""
SELECT f.cluster, f.zone_name, f.police_station, f.hour_offset, f.target_datetime, {r6('f.predicted_violations', 'predicted_violations')},
  {r6('f.confidence_low', 'confidence_low')}, {r6('f.confidence_high', 'confidence_high')},
  coalesce(v.validation_status, '') AS validation_status
FROM fc_20240131 f LEFT JOIN valid v USING (cluster, forecast_at, hour_offset)
WHERE f.hour_offset BETWEEN 1 AND 3""")
def q_forecasts_view(spark, sf):
    fc = forecasts(spark, sf)
    val = validate(candidates(spark, sf, fc))
    v = V.forecasts_view(fc, val, 1, 3)
    return out(v.select("cluster", "zone_name", "police_station", "hour_offset", "target_datetime",
                        "predicted_violations", "confidence_low", "confidence_high", "validation_status"))


@register("forecast_band", with_(*FC) + """
SELECT cluster, hour_offset, CASE WHEN predicted_violations >= 20e0 THEN 'red'
  WHEN predicted_violations >= 10e0 THEN 'orange' ELSE 'green' END AS band FROM fc_20240131""")
def q_forecast_band(spark, sf):
    fc = history_forecast(spark, sf)
    return fc.select("cluster", "hour_offset", S.forecast_band().alias("band"))


def _deploy_text(df):
    z = F.transform("top_zones", lambda s: F.concat(s["zone_name"], F.lit(":"),
                                                    S.r1(s["total_pred"]).cast("string")))
    return df.select("police_station", "total_predicted", "recommended_patrols",
                     F.array_join(z, "|").alias("top_zones"))


@register("deployment", with_(*FC) + """,
fdep AS (SELECT * FROM fc_20240131 WHERE hour_offset BETWEEN 1 AND 3 AND police_station <> 'Unknown'),
bz AS (SELECT police_station, zone_name, sum(predicted_violations) AS total_pred FROM fdep
       GROUP BY police_station, zone_name),
st AS (SELECT police_station, sum(total_pred) AS total FROM bz GROUP BY police_station),
tz AS (SELECT police_station,
         string_agg(zone_name || ':' || CAST(round_even(total_pred * 10e0, 0) / 10e0 AS VARCHAR), '|'
                    ORDER BY total_pred DESC, zone_name) AS top_zones
       FROM (SELECT *, row_number() OVER (PARTITION BY police_station ORDER BY total_pred DESC, zone_name) AS rn
             FROM bz) WHERE rn <= 3 GROUP BY police_station)
SELECT police_station, round_even(total, 0) AS total_predicted,
  CAST(greatest(1, floor(total / 15e0)) AS INTEGER) AS recommended_patrols, top_zones
FROM st JOIN tz USING (police_station) ORDER BY total_predicted DESC, police_station LIMIT 6""")
def q_deployment(spark, sf):
    return out(_deploy_text(V.deployment(history_forecast(spark, sf), 1, 3)))


@register("ingest_state", with_(*ZS) + """
SELECT max(created_datetime) AS last_ingested_datetime,
  max(id) FILTER (WHERE created_datetime = (SELECT max(created_datetime) FROM features)) AS last_ingested_id,
  count(*) AS total_rows_ingested FROM features""")
def q_ingest_state(spark, sf):
    return out(V.ingest_state(log_table(spark, sf)))


@register("score_history", with_(*ALERT_CTES) + f""",
top5 AS (SELECT cluster FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt)
         ORDER BY congestion_score DESC, cluster LIMIT 5)
SELECT cluster, zone_name, {r6('congestion_score')}, recalculated_at FROM lt WHERE cluster IN (SELECT cluster FROM top5)""")
def q_score_history(spark, sf):
    return out(V.score_history(history(spark, sf, 7), 5))


@register("latest_global", with_(*ALERT_CTES) + f"""
SELECT cluster, recalculated_at, {r6('congestion_score')} FROM lt
WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt)""")
def q_latest_global(spark, sf):
    return out(RK.latest_global(history(spark, sf, 7), "recalculated_at")
               .select("cluster", "recalculated_at", "congestion_score"))


@register("latest_per_key", with_(*ZS) + """
SELECT police_station, id, created_datetime FROM features
WHERE (police_station, created_datetime) IN (SELECT police_station, max(created_datetime) FROM features GROUP BY 1)""")
def q_latest_per_key(spark, sf):
    return out(RK.latest_per_key(log_table(spark, sf), "police_station", "created_datetime")
               .select("police_station", "id", "created_datetime"))


@register("active_clusters", with_(*ZS) + "\nSELECT DISTINCT cluster FROM features WHERE cluster <> -1")
def q_active_clusters(spark, sf):
    return AG.active_clusters(log_table(spark, sf))


@register("score_pivot", with_(*ALERT_CTES, """top AS (SELECT cluster, zone_name, row_number() OVER (
  ORDER BY congestion_score DESC, cluster) AS k FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt))""") + """
SELECT recalculated_at, """ + ", ".join(
    f"(SELECT zone_name FROM top WHERE k = {i}) AS name_{i}, " + r6(
        f"avg(congestion_score) FILTER (cluster = (SELECT cluster FROM top WHERE k = {i}))", f"zone_{i}") for i in range(1, 6)) + """
FROM lt GROUP BY recalculated_at""")
def q_score_pivot(spark, sf):
    return out(AG.score_pivot(history(spark, sf, 7)))


@register("recent_events", with_(*ZS) + """
SELECT id, created_datetime FROM features
WHERE created_datetime >= (SELECT max(created_datetime) FROM features) - INTERVAL 6 HOUR
ORDER BY created_datetime DESC, id DESC LIMIT 50""")
def q_recent_events(spark, sf):
    return out(RK.recent_events(log_table(spark, sf), 6, 50, ts="created_datetime").select("id", "created_datetime"))


@register("next_batch", with_(*ZS) + """
SELECT id, created_datetime FROM features
WHERE created_datetime > TIMESTAMP '2024-01-15 00:00:00'
   OR (created_datetime = TIMESTAMP '2024-01-15 00:00:00' AND id > 0)
ORDER BY created_datetime, id LIMIT 500""")
def q_next_batch(spark, sf):
    return out(RK.next_batch(feats(spark, sf), dt.datetime(2024, 1, 15), 0, 500).select("id", "created_datetime"))


# --- sinks -----------------------------------------------------------------------------

@register("seed_first_days", with_(*ZS) + """
SELECT id, cluster, created_datetime, created_datetime AS ingested_at FROM features
WHERE created_datetime <= (SELECT min(created_datetime) FROM features) + INTERVAL 10 DAY""")
def q_seed_first_days(spark, sf):
    return out(T.seed(feats(spark, sf), 10).select("id", "cluster", "created_datetime", "ingested_at"))


@register("insert_new", with_(*ZS) + """
SELECT id, cluster FROM features
WHERE created_datetime > (SELECT min(created_datetime) FROM features) + INTERVAL 10 DAY""")
def q_insert_new(spark, sf):
    f = feats(spark, sf)
    target = T.seed(f, 10)
    batch = f.unionByName(f.filter(F.col("id") % 10 == 0))  # replayed rows: every tenth id arrives twice
    return T.insert_new(batch, target).select("id", "cluster")


@register("append_ticks", with_(*ALERT_CTES) + f"""
SELECT cluster, recalculated_at, {r6('congestion_score')}, date_diff('day', TIMESTAMP '2024-01-09', recalculated_at) AS batch_id
FROM lt""")
def q_append_ticks(spark, sf):
    """The whole score history, a batch per tick; the last batch is replayed."""
    h = history(spark, sf, 7)
    path = scratch_path(spark, "scores")
    for b, tick in [*enumerate(TICKS), (len(TICKS) - 1, TICKS[-1])]:
        T.append(h.filter(F.col("recalculated_at") == F.lit(tick)), path, b)
    back = spark.read.parquet(path)
    return out(back.select("cluster", "recalculated_at", "congestion_score", "batch_id"))


@register("sink_roundtrip", with_(*ZS) + """
SELECT cluster, violation_count, active_days, zone_name, police_station FROM zones_named""")
def q_sink_roundtrip(spark, sf):
    f = feats(spark, sf)
    z = SC.score_batch(f)
    folder = scratch_path(spark, "outputs")
    T.write_outputs(z, SC.top_zones(z), f, folder, fmt="csv")
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
    schema = StructType([StructField(c.name, c.dataType, True) for c in z.schema.fields])
    back = spark.read.schema(schema).option("header", True).csv(f"{folder}/cluster_stats")
    return back.select(F.col("cluster").cast(IntegerType()), F.col("violation_count").cast(LongType()),
                       F.col("active_days").cast(LongType()), F.col("zone_name").cast(StringType()),
                       "police_station")


@register("snapshot_json", with_(*ALL) + """
SELECT
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt)) AS active_clusters,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'CRITICAL') AS critical_zones,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'HIGH') AS high_zones,
  (SELECT count(*) FROM lt WHERE recalculated_at = (SELECT max(recalculated_at) FROM lt) AND risk_tier = 'MEDIUM') AS medium_zones,
  (SELECT count(*) FROM alerts_acked WHERE acknowledged = 0) AS unacked_alerts,
  (SELECT count(*) FROM anoms WHERE acknowledged = 0) AS anomalies,
  (SELECT count(*) FROM features) AS total_ingested,
  (SELECT strftime(max(created_datetime), '%Y-%m-%d %H:%M:%S') FROM features) AS last_ingested""")
def q_snapshot_json(spark, sf):
    k = q_kpis(spark, sf)
    paths = T.write_snapshot({"kpis": k, "deployment": V.deployment(history_forecast(spark, sf))},
                             scratch_path(spark, "snapshot"))
    return spark.read.schema(k.schema).json(paths["kpis"])


def _digest(cols: dict[str, str]) -> str:
    """UNION of (name, rows, sum of a value) over the oracle texts of other queries."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n_rows, " + r6(f"sum(CAST({c} AS DOUBLE))", "total") + f" FROM ({SQL[n]}) AS t_{n}"
        for n, c in cols.items())


def _digests(spark, tables: dict, cols: dict[str, str]):
    """The same of DataFrames read back from a sink."""
    parts = [tables[n].agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(c).cast("double")).alias("total"))
             .select(F.lit(n).alias("name"), "n_rows", "total") for n, c in cols.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return out(res)


SNAPSHOT = {"kpis": "total_ingested", "zones": "congestion_score", "heat_volume": "latitude", "alerts_view": "congestion_score",
            "anomalies_view": "z_score", "forecasts_view": "predicted_violations", "deployment": "total_predicted",
            "ingest_state": "total_rows_ingested", "score_history": "congestion_score"}


@register("snapshot_views", _digest(SNAPSHOT))
def q_snapshot_views(spark, sf):
    """All nine views written as JSON by the executors and read back."""
    views = {n: QUERIES[n](spark, sf) for n in SNAPSHOT}
    paths = T.write_snapshot(views, scratch_path(spark, "views"))
    return _digests(spark, {n: spark.read.schema(views[n].schema).json(p) for n, p in paths.items()}, SNAPSHOT)


SINKS = {"score_batch": "congestion_score", "top_zones": "congestion_score", "features": "lanes_blocked"}


@register("sink_tables", f"SELECT f || name AS name, n_rows, total FROM (VALUES ('csv '), ('parquet ')) AS v(f), ({_digest(SINKS)})")
def q_sink_tables(spark, sf):
    """The three outputs in both formats, read back with their schemas."""
    f = feats(spark, sf)
    z = SC.score_batch(f)
    top = SC.top_zones(z)
    res = None
    for fmt in ("csv", "parquet"):
        folder = scratch_path(spark, f"sink-{fmt}")
        T.write_outputs(z, top, f, folder, fmt=fmt)
        read = lambda n, df: (spark.read.schema(df.schema).option("header", True).format(fmt)  # noqa: E731,B023
                              .load(f"{folder}/{n}"))  # noqa: B023
        back = _digests(spark, {"score_batch": read("cluster_stats", z), "top_zones": read("top_zones", top),
                                "features": read("features", f.drop("labels") if fmt == "csv" else f)}, SINKS)
        back = back.withColumn("name", F.concat(F.lit(f"{fmt} "), "name"))
        res = back if res is None else res.unionByName(back)
    return res
