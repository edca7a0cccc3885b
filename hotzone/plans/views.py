"""Serving views (V1-V10): each is one DataFrame plan over the stored tables
(score history, alerts, anomalies, forecasts, event log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.operators.ranking import latest_global, latest_per_key, recent_events, top_n, top_n_per_group

TICK = "recalculated_at"


def _one(df: DataFrame) -> DataFrame:
    """Constant key for joining one-row aggregates (a broadcast equi-join)."""
    return df.withColumn("_k", F.lit(1))


def kpis(scores: DataFrame, alerts: DataFrame, anomalies: DataFrame | None, log: DataFrame,
         ts: str = "created_datetime") -> DataFrame:
    """One row of counters (V1, D12): zones at the newest tick by tier, open
    alerts, open anomalies (0 without an anomaly table), rows in the log and
    the newest event time as text (19 characters). Each source is reduced to
    one row and the rows are joined on a constant key."""
    z = latest_global(scores, TICK).agg(
        F.count(F.lit(1)).alias("active_clusters"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_zones"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_zones"),
        F.count_if(F.col("risk_tier") == "MEDIUM").alias("medium_zones"))
    a = alerts.agg(F.count_if(F.col("acknowledged") == 0).alias("unacked_alerts"))
    if anomalies is not None:
        n = anomalies.agg(F.count_if(F.col("acknowledged") == 0).alias("anomalies"))
    else:
        n = a.sparkSession.range(1).select(F.lit(0).cast("long").alias("anomalies"))
    lg = log.agg(F.count(F.lit(1)).alias("total_ingested"),
                 F.substring(F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss"), 1, 19).alias("last_ingested"))
    b = F.broadcast
    return _one(z).join(b(_one(a)), "_k").join(b(_one(n)), "_k").join(b(_one(lg)), "_k").drop("_k")


ZONE_VIEW = ["cluster", "zone_name", "congestion_score", "risk_tier", "violation_count", "daily_rate",
             "blockage_pct", "enforcement_shift", "police_station"]


def zones_view(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Newest score of every cluster (ties kept) with its centroid; rows
    without coordinates are dropped (V2)."""
    latest = latest_per_key(scores, "cluster", TICK).select(*ZONE_VIEW)
    m = meta.select("cluster", "lat", "lon").dropDuplicates(["cluster"])
    return latest.join(m, "cluster", "left").dropna(subset=["lat", "lon"])


def heat_points(log: DataFrame, hours: int = 24, mode: str = "volume", limit: int | None = P.HEAT_LIMIT,
                ts: str = "ingested_at") -> DataFrame:
    """Map points of the last ``hours`` before the newest row, newest first,
    at most ``limit`` (V3, B28). ``impact`` mode keeps impact >= 4 and weighs
    it squared; ``volume`` weighs 1."""
    pts = recent_events(log, hours, limit, ts)
    if mode == "impact":
        pts = pts.filter(F.col("impact") >= P.HEAT_MIN_IMPACT).withColumn("weight", F.pow("impact", 2.0))
    else:
        pts = pts.withColumn("weight", F.lit(1.0))
    return pts.dropna(subset=["latitude", "longitude"]).select("latitude", "longitude", "weight")


ALERT_VIEW = ["id", "zone_name", "police_station", "previous_tier", "new_tier", "congestion_score",
              "triggered_at", "acknowledged"]


def alerts_view(alerts: DataFrame, limit: int = 20, unacked_only: bool = False) -> DataFrame:
    """Newest alerts first, at most ``limit`` (V4); ties by cluster and previous tier."""
    a = alerts.filter(F.col("acknowledged") == 0) if unacked_only else alerts
    return top_n(a, ["-triggered_at", "cluster", "previous_tier"], limit)


def anomalies_view(anoms: DataFrame, limit: int = 15) -> DataFrame:
    """Open anomalies by z descending, at most ``limit`` (V5)."""
    return top_n(anoms.filter(F.col("acknowledged") == 0), ["-z_score", "cluster", "detected_at"], limit)


def forecasts_view(fc: DataFrame, validations: DataFrame, first: int = 1, last: int = 3) -> DataFrame:
    """Newest forecast run, offsets ``first..last``, with the validation status
    and rationale (empty text when none) (V6)."""
    f = latest_global(fc, "forecast_at").filter(F.col("hour_offset").between(first, last))
    v = validations.select("cluster", "forecast_at", "hour_offset", "validation_status", "llm_rationale")
    return (f.join(v, ["cluster", "forecast_at", "hour_offset"], "left")
            .fillna({"validation_status": "", "llm_rationale": ""}))


def deployment(fc: DataFrame, first: int = 1, last: int = 3, per_patrol: float = P.PATROL_ROWS,
               zones: int = 3, stations: int = 6) -> DataFrame:
    """Patrol plan (V7, D11): per station the predicted total over offsets
    ``first..last`` (rounded half even), ``max(1, floor(total / per_patrol))``
    patrols and its ``zones`` best zones as an array; the best ``stations``
    stations, ``Unknown`` excluded. The zone list is bounded by ``zones``."""
    f = (latest_global(fc, "forecast_at").filter(F.col("hour_offset").between(first, last))
         .filter(F.col("police_station") != P.UNKNOWN))
    by_zone = f.groupBy("police_station", "zone_name").agg(F.sum("predicted_violations").alias("total_pred"))
    station = by_zone.groupBy("police_station").agg(F.sum("total_pred").alias("_total"))
    top = top_n_per_group(by_zone, ["police_station"], ["-total_pred", "zone_name"], zones, salt_col="zone_name")
    lists = top.groupBy("police_station").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "zone_name", "total_pred"))),
                    lambda s: F.struct(s["zone_name"].alias("zone_name"), s["total_pred"].alias("total_pred")))
        .alias("top_zones"))
    plan = (station.join(lists, "police_station")
            .withColumn("total_predicted", F.rint("_total"))
            .withColumn("recommended_patrols", F.greatest(F.lit(1), F.floor(F.col("_total") / per_patrol).cast("int")))
            .drop("_total"))
    return top_n(plan, ["-total_predicted", "police_station"], stations)


def ingest_state(log: DataFrame, ts: str = "created_datetime", key: str = "id") -> DataFrame:
    """Stream position (newest time and the largest id at that time) and the
    number of rows in the log (V8, H3)."""
    pos = log.agg(F.max(F.struct(ts, key)).alias("_p"), F.count(F.lit(1)).alias("total_rows_ingested"))
    return pos.select(F.col(f"_p.{ts}").alias("last_ingested_datetime"), F.col(f"_p.{key}").alias("last_ingested_id"),
                      "total_rows_ingested")


def score_history(scores: DataFrame, n: int = 5) -> DataFrame:
    """All score rows of the n best zones at the newest tick, in tick order."""
    top = top_n(latest_global(scores, TICK), ["-congestion_score", "cluster"], n).select("cluster")
    return (scores.join(F.broadcast(top), "cluster", "left_semi")
            .select("cluster", "zone_name", "congestion_score", TICK).orderBy(TICK, "cluster"))


def zone_table(scores: DataFrame, meta: DataFrame, n: int = 20) -> DataFrame:
    """Ranking table of the zones view, 8 columns, first n."""
    z = zones_view(scores, meta)
    cols = ["zone_name", "police_station", "congestion_score", "risk_tier", "violation_count", "daily_rate",
            "blockage_pct", "enforcement_shift"]
    return top_n(z, ["-congestion_score", "cluster"], n).select("cluster", *cols)


__all__ = ["Window"]
