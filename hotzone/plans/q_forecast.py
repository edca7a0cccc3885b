"""Registered queries: hourly table, history means, cluster profile, training
features, forecast grid and lookups, forecasts (C10-C12, D6-D8, D10, D16, J1-J3, A9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import forecast as FC
from hotzone.operators import ranking as RK
from hotzone.oracles import features_cte, r6, with_, zone_stats_cte
from hotzone.plans.catalog import feats, memo, out, register
from hotzone.session import scratch_path

AS_OF = dt.datetime(2024, 1, 31)

HOURLY = """hourly AS (
  SELECT cluster, date, hour, CAST(isodow(date) - 1 AS INTEGER) AS dow_num, month,
    CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST((hour < 6 OR hour >= 19) AS INTEGER) AS is_peak,
    count(impact) AS violation_count, avg(impact) AS avg_impact
  FROM features WHERE cluster <> -1
  GROUP BY cluster, date, hour, dow_num, month, is_weekend, is_peak),
hist_dow AS (SELECT cluster, hour, dow_num, avg(violation_count) AS hist_mean_violations FROM hourly
             GROUP BY cluster, hour, dow_num),
hist_hour AS (SELECT cluster, hour, avg(violation_count) AS hist_mean_ch FROM hourly GROUP BY cluster, hour),
profile AS (SELECT cluster, avg(impact) AS cluster_avg_impact, avg(lanes_blocked) AS cluster_avg_lanes,
              ln(1e0 + count(*)) AS cluster_total_log FROM features WHERE cluster <> -1 GROUP BY cluster),
train AS (
  SELECT h.*, d.hist_mean_violations, c.hist_mean_ch, p.cluster_avg_impact, p.cluster_avg_lanes,
    p.cluster_total_log, sin(2e0 * pi() * h.hour / 24e0) AS hour_sin, cos(2e0 * pi() * h.hour / 24e0) AS hour_cos,
    ln(1e0 + h.violation_count) AS label
  FROM hourly h LEFT JOIN hist_dow d USING (cluster, hour, dow_num) LEFT JOIN hist_hour c USING (cluster, hour)
  LEFT JOIN profile p USING (cluster)),
resid AS (SELECT cluster, avg(abs(violation_count - coalesce(hist_mean_violations, hist_mean_ch))) AS pred_mae
          FROM train GROUP BY cluster)"""


def grid_sql(as_of: str) -> str:
    return f"""active AS (SELECT DISTINCT cluster FROM features WHERE cluster <> -1),
grid AS (
  SELECT cluster, o AS hour_offset, TIMESTAMP '{as_of}' AS forecast_at,
    TIMESTAMP '{as_of}' + to_hours(o) AS target_ts FROM active, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS o)),
grid2 AS (
  SELECT *, CAST(hour(target_ts) AS INTEGER) AS hour, CAST(isodow(target_ts) - 1 AS INTEGER) AS dow_num,
    CAST(month(target_ts) AS INTEGER) AS month, CAST(isodow(target_ts) >= 6 AS INTEGER) AS is_weekend,
    CAST((hour(target_ts) < 6 OR hour(target_ts) >= 19) AS INTEGER) AS is_peak,
    strftime(target_ts, '%Y-%m-%d %H:%M') AS target_datetime FROM grid),
looked AS (
  SELECT g.*, coalesce(d.hist_mean_violations, c.hist_mean_ch, 1.0e0) AS hist_mean_violations,
    coalesce(c.hist_mean_ch, 1.0e0) AS hist_mean_ch
  FROM grid2 g LEFT JOIN hist_dow d USING (cluster, hour, dow_num) LEFT JOIN hist_hour c USING (cluster, hour)),
cfeat AS (
  SELECT a.cluster, coalesce(p.cluster_avg_impact, 1.0e0) AS cluster_avg_impact,
    coalesce(p.cluster_avg_lanes, 1.0e0) AS cluster_avg_lanes, coalesce(p.cluster_total_log, 0e0) AS cluster_total_log,
    coalesce(r.pred_mae, 2.0e0) AS pred_mae
  FROM active a LEFT JOIN profile p USING (cluster) LEFT JOIN resid r USING (cluster)),
fc_{as_of[:10].replace('-', '')} AS (
  SELECT l.cluster, l.forecast_at, l.hour_offset, l.target_datetime,
    round_even(greatest(0e0, l.hist_mean_violations) * 10e0, 0) / 10e0 AS predicted_violations,
    round_even(greatest(0e0, greatest(0e0, l.hist_mean_violations) - f.pred_mae) * 10e0, 0) / 10e0 AS confidence_low,
    round_even((greatest(0e0, l.hist_mean_violations) + f.pred_mae) * 10e0, 0) / 10e0 AS confidence_high,
    coalesce(z.zone_name, 'Unknown') AS zone_name, coalesce(z.police_station, 'Unknown') AS police_station
  FROM looked l JOIN cfeat f USING (cluster) LEFT JOIN zones_named z USING (cluster))"""


BASE = [features_cte(), zone_stats_cte(), HOURLY]
FC_SELECT = """SELECT cluster, forecast_at, hour_offset, target_datetime, predicted_violations, confidence_low,
  confidence_high, zone_name, police_station FROM fc_20240131"""


def history_model(spark, sf):
    return FC.train_forecast(feats(spark, sf), use_model=False)


def history_forecast(spark, sf, as_of=AS_OF):
    f = feats(spark, sf)
    fm = FC.train_forecast(f, use_model=False)
    return FC.forecast(fm, AG.active_clusters(f), as_of, meta=AG.zone_stats(f), history_weight=1.0)


@register("hourly", with_(*BASE) + "\nSELECT cluster, date, hour, dow_num, month, is_weekend, is_peak, "
          "violation_count, " + r6("avg_impact") + " FROM hourly")
def q_hourly(spark, sf):
    return out(AG.hourly_counts(feats(spark, sf)))


@register("hist_dow", with_(*BASE) + "\nSELECT cluster, hour, dow_num, " + r6("hist_mean_violations") + " FROM hist_dow")
def q_hist_dow(spark, sf):
    return out(AG.hist_means(AG.hourly_counts(feats(spark, sf)))[0])


@register("hist_hour", with_(*BASE) + "\nSELECT cluster, hour, " + r6("hist_mean_ch") + " FROM hist_hour")
def q_hist_hour(spark, sf):
    return out(AG.hist_means(AG.hourly_counts(feats(spark, sf)))[1])


@register("cluster_profile", with_(*BASE) + "\nSELECT cluster, " + ", ".join(
    r6(c) for c in ["cluster_avg_impact", "cluster_avg_lanes", "cluster_total_log"]) + " FROM profile")
def q_cluster_profile(spark, sf):
    return out(AG.cluster_profile(feats(spark, sf)))


TRAIN_D = ["avg_impact", "hist_mean_violations", "hist_mean_ch", "cluster_avg_impact", "cluster_avg_lanes",
           "cluster_total_log", "hour_sin", "hour_cos", "label"]
TRAIN_O = ["cluster", "date", "hour", "dow_num", "month", "is_weekend", "is_peak", "violation_count"]


@register("forecast_features", with_(*BASE) + "\nSELECT " + ", ".join(TRAIN_O + [r6(c) for c in TRAIN_D]) + " FROM train")
def q_forecast_features(spark, sf):
    return out(FC.forecast_features(feats(spark, sf)).select(*TRAIN_O, *TRAIN_D))


GRID = BASE + [grid_sql("2024-01-31 00:00:00")]


@register("forecast_grid", with_(*GRID) + """
SELECT cluster, hour_offset, forecast_at, hour, dow_num, month, is_weekend, is_peak, target_datetime FROM grid2""")
def q_forecast_grid(spark, sf):
    g = FC.forecast_grid(AG.active_clusters(feats(spark, sf)), AS_OF)
    return out(g.select("cluster", "hour_offset", "forecast_at", "hour", "dow_num", "month", "is_weekend",
                        "is_peak", "target_datetime"))


@register("hist_lookup", with_(*GRID) + "\nSELECT cluster, hour_offset, " + r6("hist_mean_violations") + ", "
          + r6("hist_mean_ch") + " FROM looked")
def q_hist_lookup(spark, sf):
    f = feats(spark, sf)
    by_dow, by_hour = AG.hist_means(AG.hourly_counts(f))
    g = FC.hist_lookup(FC.forecast_grid(AG.active_clusters(f), AS_OF), by_dow, by_hour)
    return out(g.select("cluster", "hour_offset", "hist_mean_violations", "hist_mean_ch"))


@register("cluster_features", with_(*GRID) + "\nSELECT cluster, " + ", ".join(
    r6(c) for c in ["cluster_avg_impact", "cluster_avg_lanes", "cluster_total_log", "pred_mae"]) + " FROM cfeat")
def q_cluster_features(spark, sf):
    fm = history_model(spark, sf)
    c = FC.cluster_features(AG.active_clusters(feats(spark, sf)), fm.profile, fm.residuals)
    return out(c)


@register("forecast_history_only", with_(*GRID) + "\n" + FC_SELECT)
def q_forecast_history_only(spark, sf):
    return out(history_forecast(spark, sf))


@register("latest_run", with_(*(BASE + [grid_sql("2024-01-31 00:00:00")])).replace("WITH ", "WITH ", 1) + "\n"
          + FC_SELECT)
def q_latest_run(spark, sf):
    runs = history_forecast(spark, sf, dt.datetime(2024, 1, 30, 12)).unionByName(history_forecast(spark, sf))
    return out(RK.latest_global(runs, "forecast_at"))


def gbt_model(spark, sf):
    """The fitted forecaster, trained once per application (the original caches it too)."""
    def build():
        folder = scratch_path(spark, "gbt")
        FC.train_forecast(feats(spark, sf)).save(folder)
        return FC.ForecastModel.load(spark, folder)

    return memo(spark, ("gbt", sf), build)


@register("forecast_train")
def q_forecast_train(spark, sf):
    fm = gbt_model(spark, sf)
    return out(fm.train.select("cluster", "date", "hour", "violation_count", "model_pred", "hist_pred"))


@register("forecast")
def q_forecast(spark, sf):
    f = feats(spark, sf)
    return out(FC.forecast(gbt_model(spark, sf), AG.active_clusters(f), AS_OF, meta=AG.zone_stats(f)))


@register("forecast_error", with_(*BASE) + "\nSELECT "
          + r6("avg(abs(violation_count - coalesce(hist_mean_violations, hist_mean_ch)))", "mae") + " FROM train")
def q_forecast_error(spark, sf):
    """Mean absolute error of the history prediction."""
    return out(AG.mae(history_model(spark, sf).train, "violation_count", "hist_pred"))


@register("forecast_quality")
def q_forecast_quality(spark, sf):
    return out(FC.forecast_quality(gbt_model(spark, sf)))


@register("forecast_bounds", with_(*GRID) + """
SELECT (SELECT count(*) FROM fc_20240131) AS n_rows, 0 AS n_negative, 0 AS n_outside_band, true AS ensemble_between""")
def q_forecast_bounds(spark, sf):
    """What must hold of the model's forecast, in one row."""
    f = feats(spark, sf)
    fm = gbt_model(spark, sf)
    fc = FC.forecast(fm, AG.active_clusters(f), AS_OF, meta=AG.zone_stats(f))
    p, lo, hi = F.col("predicted_violations"), F.col("confidence_low"), F.col("confidence_high")
    got = fc.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((p < 0) | (lo < 0)).alias("n_negative"),
                 F.count_if((p < lo) | (p > hi)).alias("n_outside_band"))
    err = FC.forecast_quality(fm).join(AG.mae(fm.train, "violation_count", "hist_pred"), F.lit(True))
    between = F.col("mae_ensemble") <= F.greatest("mae_model", "mae")
    return got.join(err.select(between.alias("ensemble_between")), F.lit(True))


@register("importances")
def q_importances(spark, sf):
    return out(FC.importances(gbt_model(spark, sf)))
