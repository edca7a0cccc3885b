"""Registered queries: zone statistics, scores, tiers and rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hotzone.functions import scalar as S
from hotzone.operators import aggregates as AG
from hotzone.operators import ranking as RK
from hotzone.operators import scoring as SC
from hotzone.oracles import (BATCH_W, LIVE_W, SHIFT_BATCH, SHIFT_LIVE, TIER, features_cte, mode_cte, r6, score_cte,
                             with_, zone_stats_cte)
from hotzone.plans.catalog import feats, out, raw, register
from hotzone.plans.q_spatial import nearest_features_cte

AS_OF = dt.datetime(2024, 1, 31)
TICKS = [dt.datetime(2024, 1, 9) + dt.timedelta(days=i) for i in range(23)]
TICK_WINDOW_DAYS = 7


def zones(spark, sf):
    return SC.score_batch(feats(spark, sf))


def live(spark, sf, as_of=AS_OF, window="30 days"):
    f = feats(spark, sf)
    return SC.score_live(f, as_of, window, meta=SC.zone_meta(AG.zone_stats(f)))


def ticks(spark, sf):
    f = feats(spark, sf)
    return SC.score_ticks(spark, f, TICKS, TICK_WINDOW_DAYS, meta=SC.zone_meta(AG.zone_stats(f)))


ZS = [features_cte(), zone_stats_cte()]
STAT_DOUBLES = ["lat", "lon", "total_impact", "avg_impact", "avg_lanes_blocked", "peak_pct", "weekend_pct",
                "approved_pct", "scita_pct", "fixed_camera_pct", "compound_pct"]
STAT_OTHER = ["cluster", "violation_count", "active_days", "active_weeks", "junction_label", "police_station",
              "top_vehicle", "zone_name"]


def _sel(doubles, other, src):
    return "SELECT " + ", ".join(other + [r6(c) for c in doubles]) + f" FROM {src}"


@register("zone_stats", with_(*ZS) + "\n" + _sel(STAT_DOUBLES, STAT_OTHER, "zones_named"))
def q_zone_stats(spark, sf):
    return out(AG.zone_stats(feats(spark, sf)).select(*STAT_OTHER, *STAT_DOUBLES))


@register("mode", with_(*ZS) + "\nSELECT cluster, police_station, top_vehicle FROM zones_named")
def q_mode(spark, sf):
    f = feats(spark, sf).filter(F.col("cluster") != -1)
    return AG.modes(f, ["cluster"], {"police_station": F.col("police_station"), "top_vehicle": F.col("final_vehicle_type")})


@register("junction_label", with_(*ZS) + "\nSELECT cluster, junction_label FROM zones_named")
def q_junction_label(spark, sf):
    return AG.zone_stats(feats(spark, sf)).select("cluster", "junction_label")


@register("zone_name", with_(*ZS) + "\nSELECT cluster, zone_name FROM zones_named")
def q_zone_name(spark, sf):
    return AG.zone_stats(feats(spark, sf)).select("cluster", "zone_name")


BATCH = ZS + [score_cte("bscore", "zones_named", BATCH_W)]
COMP = ["c_impact", "c_lanes", "c_peak", "c_consistency", "c_persistence", "c_official", "c_compound"]
BATCH_OUT_D = STAT_DOUBLES + COMP + ["raw_score", "congestion_score", "blockage_pct", "daily_rate"]


@register("score_batch", with_(*BATCH) + "\nSELECT " + ", ".join(
    STAT_OTHER + [r6(c) for c in BATCH_OUT_D]) + f""",
  {TIER} AS risk_tier, {SHIFT_BATCH} AS enforcement_shift,
  CASE WHEN weekend_pct > 0.55e0 THEN 'Weekend-heavy' ELSE 'Weekday-uniform' END AS weekend_bias
FROM bscore""")
def q_score_batch(spark, sf):
    z = zones(spark, sf)
    return out(z.select(*STAT_OTHER, *BATCH_OUT_D, "risk_tier", "enforcement_shift", "weekend_bias"))


@register("minmax", with_(*BATCH) + "\nSELECT cluster, " + ", ".join(r6(c) for c in COMP) + " FROM bscore")
def q_minmax(spark, sf):
    return out(zones(spark, sf).select("cluster", *COMP))


@register("risk_tier", with_(*BATCH) + f"\nSELECT cluster, {r6('congestion_score')}, {TIER} AS risk_tier FROM bscore")
def q_risk_tier(spark, sf):
    return out(zones(spark, sf).select("cluster", "congestion_score", "risk_tier"))


@register("shift_batch", with_(*BATCH) + f"\nSELECT cluster, {r6('peak_pct')}, {SHIFT_BATCH} AS enforcement_shift FROM bscore")
def q_shift_batch(spark, sf):
    return out(zones(spark, sf).select("cluster", "peak_pct", "enforcement_shift"))


@register("weekend_bias", with_(*BATCH) + f"""
SELECT cluster, {r6('weekend_pct')},
  CASE WHEN weekend_pct > 0.55e0 THEN 'Weekend-heavy' ELSE 'Weekday-uniform' END AS weekend_bias FROM bscore""")
def q_weekend_bias(spark, sf):
    return out(zones(spark, sf).select("cluster", "weekend_pct", "weekend_bias"))


@register("top_zones", with_(*BATCH) + f"""
SELECT cluster, zone_name, {r6('congestion_score')}, CAST(rank AS INTEGER) AS rank, {r6('peak_pct_pct')} FROM (
  SELECT *, row_number() OVER (ORDER BY congestion_score DESC, cluster) AS rank,
    round_even(peak_pct * 100e0 * 10e0, 0) / 10e0 AS peak_pct_pct
  FROM bscore ORDER BY congestion_score DESC, cluster LIMIT 20)""")
def q_top_zones(spark, sf):
    t = SC.top_zones(zones(spark, sf), 20)
    return out(t.select("cluster", "zone_name", "congestion_score", "rank", "peak_pct_pct"))


@register("topn", with_(*BATCH) + f"""
SELECT cluster, zone_name, {r6('congestion_score')} FROM bscore ORDER BY congestion_score DESC, cluster LIMIT 5""")
def q_topn(spark, sf):
    return out(RK.top_n(zones(spark, sf), ["-congestion_score", "cluster"], 5)
               .select("cluster", "zone_name", "congestion_score"))


@register("topn_per_group", with_(*BATCH) + f"""
SELECT police_station, cluster, {r6('congestion_score')}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY police_station ORDER BY congestion_score DESC, cluster) AS rank
  FROM bscore) WHERE rank <= 3""")
def q_topn_per_group(spark, sf):
    t = RK.top_n_per_group(zones(spark, sf), ["police_station"], ["-congestion_score", "cluster"], 3,
                           salt_col="cluster")
    return out(t.select("police_station", "cluster", "congestion_score", "rank"))


# --- live scores -------------------------------------------------------------

def wstats_cte(ticks_sql: str, window_days: int, sfx: str = "") -> list[str]:
    """Live scores per tick as CTEs; ``sfx`` keeps two histories apart in one text."""
    return [
        f"ticks{sfx} AS ({ticks_sql})",
        f"""wrows{sfx} AS (
  SELECT t.recalculated_at, f.* FROM features f JOIN ticks{sfx} t
    ON f.created_datetime >= t.recalculated_at - INTERVAL {window_days} DAY
   AND f.created_datetime < t.recalculated_at
  WHERE f.cluster <> -1)""",
        mode_cte(f"m_wstation{sfx}", f"wrows{sfx}", "recalculated_at, cluster", "police_station"),
        f"""wstats{sfx} AS (
  SELECT a.*, m.m_wstation{sfx}_value AS police_station FROM (
    SELECT recalculated_at, cluster,
      count(impact) AS violation_count,
      coalesce(CAST(sum(CAST(impact AS DECIMAL(28,6))) AS DOUBLE), 0e0) AS total_impact,
      CAST(sum(CAST(lanes_blocked AS DECIMAL(28,6))) AS DOUBLE) / count(lanes_blocked) AS avg_lanes_blocked,
      avg(CASE WHEN is_peak THEN 1e0 ELSE 0e0 END) AS peak_pct,
      count(DISTINCT date) AS active_days, count(DISTINCT week) AS active_weeks,
      avg(CASE WHEN validation_weight = 1.5e0 THEN 1e0 ELSE 0e0 END) AS approved_pct,
      avg(CASE WHEN scita_weight = 1.2e0 THEN 1e0 ELSE 0e0 END) AS scita_pct,
      avg(CASE WHEN compound_score > 1.0e0 THEN 1e0 ELSE 0e0 END) AS compound_pct
    FROM wrows{sfx} GROUP BY recalculated_at, cluster) a
  LEFT JOIN m_wstation{sfx} m USING (recalculated_at, cluster))""",
        score_cte(f"lscore{sfx}", f"wstats{sfx}", LIVE_W, "PARTITION BY recalculated_at"),
        f"""live{sfx} AS (
  SELECT l.*, coalesce(z.zone_name, l.police_station || ' area') AS zone_name FROM lscore{sfx} l
  LEFT JOIN (SELECT cluster, zone_name FROM zones_named) z USING (cluster))""",
    ]


LIVE_D = ["total_impact", "avg_lanes_blocked", "peak_pct", "approved_pct", "scita_pct", "compound_pct",
          "congestion_score", "daily_rate", "blockage_pct"]
LIVE_O = ["cluster", "recalculated_at", "violation_count", "active_days", "active_weeks", "zone_name",
          "police_station"]
LIVE_SELECT = ("SELECT " + ", ".join(LIVE_O + [r6(c) for c in LIVE_D])
               + f", {TIER} AS risk_tier, {SHIFT_LIVE} AS enforcement_shift FROM live")
ONE_TICK = "SELECT TIMESTAMP '2024-01-31 00:00:00' AS recalculated_at"
MANY_TICKS = ("SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-31', "
              "INTERVAL 1 DAY)) AS TIMESTAMP) AS recalculated_at")
LIVE_ONE = ZS + wstats_cte(ONE_TICK, 30)
LIVE_MANY = ZS + wstats_cte(MANY_TICKS, TICK_WINDOW_DAYS)


def _live_out(df):
    return out(df.select(*LIVE_O, *LIVE_D, "risk_tier", "enforcement_shift"))


@register("window_stats", with_(*LIVE_ONE) + "\nSELECT recalculated_at, cluster, violation_count, active_days, "
          "active_weeks, police_station, " + ", ".join(r6(c) for c in LIVE_D[:6]) + " FROM wstats")
def q_window_stats(spark, sf):
    f = feats(spark, sf)
    a = F.lit(AS_OF).cast("timestamp")
    rows = f.filter((F.col("cluster") != -1) & (F.col("created_datetime") >= a - F.expr("INTERVAL 30 DAYS"))
                    & (F.col("created_datetime") < a))
    st = AG.window_stats(rows, ["cluster"]).withColumn("recalculated_at", a)
    return out(st.select("recalculated_at", "cluster", "violation_count", "active_days", "active_weeks",
                         "police_station", *LIVE_D[:6]))


@register("score_live", with_(*LIVE_ONE) + "\n" + LIVE_SELECT)
def q_score_live(spark, sf):
    return _live_out(live(spark, sf))


@register("shift_live", with_(*LIVE_ONE) + f"\nSELECT cluster, {r6('peak_pct')}, {SHIFT_LIVE} AS enforcement_shift FROM live")
def q_shift_live(spark, sf):
    return out(live(spark, sf).select("cluster", "peak_pct", "enforcement_shift"))


@register("score_ticks", with_(*LIVE_MANY) + "\n" + LIVE_SELECT)
def q_score_ticks(spark, sf):
    return _live_out(ticks(spark, sf))


HOURLY = [dt.datetime(2024, 1, 20, 3) + dt.timedelta(hours=i) for i in range(24)]
HOURLY_SQL = ("SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-20 03:00:00', TIMESTAMP '2024-01-21 02:00:00', "
              "INTERVAL 1 HOUR)) AS TIMESTAMP) AS recalculated_at")


@register("score_ticks_hourly", with_(*ZS, *wstats_cte(HOURLY_SQL, TICK_WINDOW_DAYS)) + "\n" + LIVE_SELECT)
def q_score_ticks_hourly(spark, sf):
    """Ticks on the hour, from hour buckets."""
    f = feats(spark, sf)
    return _live_out(SC.score_ticks(spark, f, HOURLY, TICK_WINDOW_DAYS, meta=SC.zone_meta(AG.zone_stats(f))))


MINUTES = [dt.datetime(2024, 1, 30, 0, 1) + dt.timedelta(minutes=i) for i in range(1440)]
MINUTES_SQL = ("SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-30 00:01:00', TIMESTAMP '2024-01-31 00:00:00', "
               "INTERVAL 1 MINUTE)) AS TIMESTAMP) AS recalculated_at")


@register("score_ticks_minutely", with_(*ZS, *wstats_cte(MINUTES_SQL, 2)) + "\n" + LIVE_SELECT)
def q_score_ticks_minutely(spark, sf):
    """Ticks every minute of a day, over two-day windows (shorter than a week)."""
    f = feats(spark, sf)
    return _live_out(SC.score_ticks(spark, f, MINUTES, 2, meta=SC.zone_meta(AG.zone_stats(f))))


@register("retain_scores", with_(*LIVE_MANY) + "\n" + LIVE_SELECT
          + " WHERE recalculated_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY")
def q_retain_scores(spark, sf):
    return _live_out(SC.retain(ticks(spark, sf), AS_OF, "3 days"))


@register("zone_meta", with_(*LIVE_ONE) + f"""
SELECT l.cluster, l.zone_name, {r6('congestion_score')}, {r6('z.lat', 'lat')}, {r6('z.lon', 'lon')}
FROM live l LEFT JOIN zones_named z USING (cluster)""")
def q_zone_meta(spark, sf):
    f = feats(spark, sf)
    meta = SC.zone_meta(AG.zone_stats(f))
    sc = SC.score_live(f, AS_OF, "30 days", meta=meta)
    j = SC.with_zone_meta(sc.select("cluster", "zone_name", "congestion_score"), meta.select("cluster", "lat", "lon"))
    return out(j)


@register("prep_kpis", with_(*BATCH) + f""",
rb AS (SELECT count(*) AS rows_in_box,
         avg(CASE WHEN updated_vehicle_type IS NOT NULL THEN 1e0 ELSE 0e0 END) AS corrected_type_share
       FROM violations_raw
       WHERE latitude BETWEEN 12.75e0 AND 13.15e0 AND longitude BETWEEN 77.35e0 AND 77.85e0),
fk AS (SELECT count(*) AS rows_kept, count(*) FILTER (WHERE cluster <> -1) AS rows_assigned,
         avg(CASE WHEN is_peak THEN 1e0 ELSE 0e0 END) AS peak_share,
         avg(CASE WHEN device_type = 'fixed_camera' THEN 1e0 ELSE 0e0 END) AS fixed_camera_share,
         count(*) FILTER (WHERE data_sent_to_scita) AS flagged_rows FROM features),
zk AS (SELECT count(*) AS clusters,
         count(*) FILTER (WHERE congestion_score >= 75) AS critical_zones,
         count(*) FILTER (WHERE congestion_score >= 50 AND congestion_score < 75) AS high_zones FROM bscore),
tk AS (SELECT avg(blockage_pct) AS top_blockage_pct FROM
         (SELECT blockage_pct FROM bscore ORDER BY congestion_score DESC, cluster LIMIT 10))
SELECT rows_in_box, {r6('corrected_type_share')}, rows_kept, rows_assigned, {r6('peak_share')},
  {r6('fixed_camera_share')}, flagged_rows, clusters, critical_zones, high_zones, {r6('top_blockage_pct')},
  rows_in_box - rows_kept AS rows_removed, {r6('rows_assigned / rows_kept', 'assigned_share')}
FROM rb, fk, zk, tk""")
def q_prep_kpis(spark, sf):
    f = feats(spark, sf)
    return out(AG.prep_kpis(raw(spark, sf), f, SC.score_batch(f)))


__all__ = ["zones", "live", "ticks", "AS_OF", "TICKS", "S"]


@register("rank_zones_now", with_(*nearest_features_cte(), zone_stats_cte(), *wstats_cte(ONE_TICK, 30)) + "\n" + LIVE_SELECT)
def q_rank_zones_now(spark, sf):
    """The main chain: raw records, clustering, centroids, nearest centroid, live score."""
    from hotzone.plans.flagship import rank_zones_now

    return _live_out(rank_zones_now(spark, sf))
