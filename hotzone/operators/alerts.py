"""Tier-change alerts, top-10 entrants, rate spikes and rate anomalies
(C8, C9, C19, G2, G3, I1, I2).

All of them work on score history: one row per (tick, zone), already
aggregated, so the joins here are between small tables; AQE broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions import scalar as S
from hotzone.operators.ranking import top_n_per_group

TICK = "recalculated_at"

ALERT_COLUMNS = ["cluster", "zone_name", "police_station", "previous_tier", "new_tier", "congestion_score",
                 "triggered_at", "severity"]


def tick_numbers(scores: DataFrame, ts: str = TICK) -> DataFrame:
    """1, 2, ... for the distinct ticks in time order. The window sees one row
    per tick: a time index bounded by the history kept (retention), not by the
    data volume."""
    ticks = scores.select(ts).distinct()
    return ticks.withColumn("tick_no", F.row_number().over(Window.orderBy(ts)))


def _numbered(scores: DataFrame, ts: str) -> DataFrame:
    return scores if "tick_no" in scores.columns else scores.join(F.broadcast(tick_numbers(scores, ts)), ts)


def with_previous(scores: DataFrame, ts: str = TICK) -> DataFrame:
    """Each zone row of every tick but the first, with the zone's tier, score and
    daily rate at the previous tick (C8). A zone absent there counts as LOW."""
    s = _numbered(scores, ts)
    prev = s.select("cluster", (F.col("tick_no") + 1).alias("tick_no"),
                    F.col("risk_tier").alias("previous_tier"),
                    F.col("congestion_score").alias("previous_score"),
                    F.col("daily_rate").alias("previous_rate"))
    return (s.filter(F.col("tick_no") > 1).join(prev, ["cluster", "tick_no"], "left")
            .withColumn("previous_tier", F.coalesce("previous_tier", F.lit("LOW"))))


def new_entrants(scores: DataFrame, n: int = P.TOP_ENTRANTS_N, ts: str = TICK) -> DataFrame:
    """Zones in a tick's top n that were not in the previous tick's top n.
    A tick holds one row per zone, so its group is bounded: one window."""
    s = _numbered(scores, ts)
    top = top_n_per_group(s, ["tick_no"], ["-congestion_score", "cluster"], n, salt_buckets=1).drop("rank")
    prev = top.select("cluster", (F.col("tick_no") + 1).alias("tick_no"))
    return top.filter(F.col("tick_no") > 1).join(prev, ["cluster", "tick_no"], "left_anti")


def tier_alerts(scores: DataFrame, n: int = P.TOP_ENTRANTS_N, ts: str = TICK,
                suppress_by: str = "zone_name") -> DataFrame:
    """Alerts for every tick (G2): one per zone whose tier changed since the
    previous tick, with the new score, plus top-n entrants with previous tier
    NONE unless a zone of the same name already changed tier in that tick.
    ``suppress_by="cluster"`` matches entrants by cluster instead of by name
    (two clusters may share a name: Q29)."""
    scores = _numbered(scores, ts)
    pairs = with_previous(scores, ts)
    changes = (pairs.filter(F.col("previous_tier") != F.col("risk_tier"))
               .select("tick_no", "cluster", "zone_name", "police_station", "previous_tier",
                       F.col("risk_tier").alias("new_tier"), "congestion_score", F.col(ts).alias("triggered_at")))
    entr = new_entrants(scores, n, ts)
    entr = entr.join(changes.select("tick_no", suppress_by), ["tick_no", suppress_by], "left_anti")
    entr = entr.select("tick_no", "cluster", "zone_name", "police_station", F.lit("NONE").alias("previous_tier"),
                       F.col("risk_tier").alias("new_tier"), "congestion_score", F.col(ts).alias("triggered_at"))
    alerts = changes.unionByName(entr).withColumn("severity", S.alert_severity())
    return alerts.drop("tick_no").select(
        F.xxhash64("triggered_at", "cluster", "previous_tier").alias("id"), *ALERT_COLUMNS)


def rate_spikes(scores: DataFrame, share: float = P.RATE_SPIKE_SHARE, ts: str = TICK) -> DataFrame:
    """Zones whose daily rate rose by more than ``share`` on the previous tick."""
    p = with_previous(scores, ts).filter(F.col("previous_rate") > 0)
    change = (F.col("daily_rate") - F.col("previous_rate")) / F.col("previous_rate")
    return (p.withColumn("rate_change", change).filter(F.col("rate_change") > share)
            .select(ts, "cluster", "zone_name", "daily_rate", "previous_rate", "rate_change"))


ANOMALY_COLUMNS = ["cluster", "zone_name", "police_station", "current_rate", "baseline_rate", "z_score",
                   "anomaly_type", "severity", "detected_at"]


def rate_anomalies(scores: DataFrame, baseline: DataFrame, z_min: float = P.Z_MODERATE, ts: str = TICK) -> DataFrame:
    """Daily-rate anomalies of every tick against the per-zone baseline.

    ``z = (rate - mean) / max(std, 0.5)``; rows with ``|z| >= z_min`` are kept
    (a null z is dropped), z is rounded half-even to 2 places. Keyed by
    (cluster, tick), so re-running a tick gives the same rows.
    """
    j = scores.join(baseline, "cluster", "inner")  # one baseline row per cluster: AQE broadcasts it
    z = (F.col("daily_rate") - F.col("baseline_mean")) / F.greatest(F.col("baseline_std"), F.lit(P.STD_FLOOR))
    j = j.withColumn("_z", z).filter(F.abs(F.col("_z")) >= z_min)
    out = j.select(
        "cluster",
        F.coalesce(F.col("zone_name"), F.lit(P.UNKNOWN)).alias("zone_name"),
        F.coalesce(F.col("police_station"), F.lit(P.UNKNOWN)).alias("police_station"),
        F.col("daily_rate").alias("current_rate"),
        F.col("baseline_mean").alias("baseline_rate"),
        S.round_even(F.col("_z"), 2).alias("z_score"),
        S.anomaly_type("_z").alias("anomaly_type"),
        S.anomaly_severity("_z").alias("severity"),
        F.col(ts).alias("detected_at"),
    )
    return out.select(F.xxhash64("detected_at", "cluster").alias("id"), *ANOMALY_COLUMNS)
