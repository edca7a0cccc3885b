"""Registered queries: previous-tick join, tier alerts, entrants, rate spikes,
alert severity, baseline and anomalies (B26, B27, C8, C19, D9, G2, G3, I1, I2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import alerts as AL
from hotzone.operators import scoring as SC
from hotzone.oracles import SHIFT_LIVE, TIER, features_cte, r6, with_, zone_stats_cte
from hotzone.plans.catalog import feats, out, register, stored
from hotzone.plans.q_scoring import MANY_TICKS, TICKS, wstats_cte

ZS = [features_cte(), zone_stats_cte()]


def history(spark, sf, window_days):
    """Score history of all ticks, written once to the checkpoint folder (it is a
    stored table in the live system; later steps read it several times)."""
    def build():
        f = feats(spark, sf)
        return SC.score_ticks(spark, f, TICKS, window_days, meta=SC.zone_meta(AG.zone_stats(f)))

    return stored(spark, ("history", sf, window_days), build)


def scores_7d(spark, sf):
    return history(spark, sf, 7)


def scores_1d(spark, sf):
    return history(spark, sf, 1)


def history_ctes(window_days: int, sfx: str = "", ticks_sql: str = MANY_TICKS) -> list[str]:
    return ZS + wstats_cte(ticks_sql, window_days, sfx) + [
        f"lt{sfx} AS (SELECT *, {TIER} AS risk_tier, {SHIFT_LIVE} AS enforcement_shift FROM live{sfx})",
        f"""tk{sfx} AS (SELECT recalculated_at, row_number() OVER (ORDER BY recalculated_at) AS tn
       FROM (SELECT DISTINCT recalculated_at FROM lt{sfx}))""",
        f"ls{sfx} AS (SELECT lt{sfx}.*, tk{sfx}.tn FROM lt{sfx} JOIN tk{sfx} USING (recalculated_at))",
        f"""pairs{sfx} AS (
  SELECT cur.*, coalesce(prev.risk_tier, 'LOW') AS previous_tier, prev.congestion_score AS previous_score,
         prev.daily_rate AS previous_rate
  FROM ls{sfx} cur LEFT JOIN ls{sfx} prev ON prev.cluster = cur.cluster AND prev.tn = cur.tn - 1
  WHERE cur.tn > 1)""",
    ]


SEVERITY = """CASE previous_tier || '>' || new_tier
    WHEN 'LOW>MEDIUM' THEN 'info' WHEN 'MEDIUM>HIGH' THEN 'warning' WHEN 'HIGH>CRITICAL' THEN 'urgent'
    WHEN 'CRITICAL>HIGH' THEN 'resolved' WHEN 'HIGH>MEDIUM' THEN 'resolved' WHEN 'MEDIUM>LOW' THEN 'resolved'
    WHEN 'CRITICAL>MEDIUM' THEN 'resolved' WHEN 'CRITICAL>LOW' THEN 'resolved' ELSE 'info' END"""

def alert_ctes(ticks_sql: str = MANY_TICKS) -> list[str]:
    return history_ctes(7, "", ticks_sql) + ALERT_TAIL


ALERT_TAIL = [
    """changes AS (SELECT tn, cluster, zone_name, police_station, previous_tier, risk_tier AS new_tier,
       congestion_score, recalculated_at AS triggered_at FROM pairs WHERE previous_tier <> risk_tier)""",
    """top10 AS (SELECT tn, cluster FROM (
       SELECT tn, cluster, row_number() OVER (PARTITION BY tn ORDER BY congestion_score DESC, cluster) AS rn
       FROM ls) WHERE rn <= 10)""",
    """entr AS (SELECT t.tn, t.cluster FROM top10 t
       WHERE t.tn > 1 AND NOT EXISTS (SELECT 1 FROM top10 p WHERE p.tn = t.tn - 1 AND p.cluster = t.cluster))""",
    """entr_alerts AS (
  SELECT ls.tn, ls.cluster, ls.zone_name, ls.police_station, 'NONE' AS previous_tier, ls.risk_tier AS new_tier,
         ls.congestion_score, ls.recalculated_at AS triggered_at
  FROM entr JOIN ls USING (tn, cluster)
  WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.tn = ls.tn AND c.zone_name = ls.zone_name))""",
    f"""alerts AS (SELECT *, {SEVERITY} AS severity FROM (
       SELECT * FROM changes UNION ALL SELECT * FROM entr_alerts))""",
]
ALERT_CTES = alert_ctes()


@register("prev_tick", with_(*history_ctes(7)) + f"""
SELECT recalculated_at, cluster, risk_tier, previous_tier, {r6('previous_score')}, {r6('previous_rate')} FROM pairs""")
def q_prev_tick(spark, sf):
    p = AL.with_previous(scores_7d(spark, sf))
    return out(p.select("recalculated_at", "cluster", "risk_tier", "previous_tier", "previous_score",
                        "previous_rate"))


@register("new_entrants", with_(*ALERT_CTES) + """
SELECT ls.recalculated_at, ls.cluster FROM entr JOIN ls USING (tn, cluster)""")
def q_new_entrants(spark, sf):
    return out(AL.new_entrants(scores_7d(spark, sf)).select("recalculated_at", "cluster"))


@register("tier_alerts", with_(*ALERT_CTES) + f"""
SELECT cluster, zone_name, police_station, previous_tier, new_tier, {r6('congestion_score')}, triggered_at, severity
FROM alerts""")
def q_tier_alerts(spark, sf):
    return out(AL.tier_alerts(scores_7d(spark, sf)).drop("id"))


@register("alert_severity", with_(*ALERT_CTES) + """
SELECT previous_tier, new_tier, severity, count(*) AS n FROM alerts GROUP BY ALL""")
def q_alert_severity(spark, sf):
    a = AL.tier_alerts(scores_7d(spark, sf))
    return a.groupBy("previous_tier", "new_tier", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("rate_spikes", with_(*history_ctes(1)) + f"""
SELECT recalculated_at, cluster, zone_name, {r6('daily_rate')}, {r6('previous_rate')},
  {r6('(daily_rate - previous_rate) / previous_rate', 'rate_change')}
FROM pairs WHERE previous_rate > 0 AND (daily_rate - previous_rate) / previous_rate > 0.25e0""")
def q_rate_spikes(spark, sf):
    return out(AL.rate_spikes(scores_1d(spark, sf)))


BASELINE = """daily AS (SELECT cluster, date, count(*) AS daily_count FROM features WHERE cluster <> -1
                GROUP BY cluster, date),
baseline AS (SELECT cluster, avg(daily_count) AS baseline_mean,
                coalesce(stddev_samp(daily_count), 1.0e0) AS baseline_std, count(*) AS baseline_n
             FROM daily GROUP BY cluster)"""


@register("baseline", with_(features_cte(), BASELINE) + f"""
SELECT cluster, {r6('baseline_mean')}, {r6('baseline_std')}, baseline_n FROM baseline""")
def q_baseline(spark, sf):
    return out(AG.rate_baseline(feats(spark, sf)))


ANOM = """anom AS (
  SELECT l.*, b.baseline_mean, (l.daily_rate - b.baseline_mean) / greatest(b.baseline_std, 0.5e0) AS z
  FROM lt l JOIN baseline b USING (cluster))"""
ANOM_SELECT = f"""
SELECT cluster, coalesce(zone_name, 'Unknown') AS zone_name, coalesce(police_station, 'Unknown') AS police_station,
  {r6('daily_rate', 'current_rate')}, {r6('baseline_mean', 'baseline_rate')},
  {r6('round_even(z * 100e0, 0) / 100e0', 'z_score')},
  CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS anomaly_type,
  CASE WHEN abs(z) >= 4.5e0 THEN 'extreme' WHEN abs(z) >= 3e0 THEN 'severe' ELSE 'moderate' END AS severity,
  recalculated_at AS detected_at
FROM anom WHERE abs(z) >= 2e0"""


@register("anomalies", with_(*history_ctes(1), BASELINE, ANOM) + ANOM_SELECT)
def q_anomalies(spark, sf):
    return out(AL.rate_anomalies(scores_1d(spark, sf), AG.rate_baseline(feats(spark, sf))).drop("id"))
