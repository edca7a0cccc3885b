"""Hourly forecast per zone.

Training table: one row per (cluster, date, hour) with 12 features; target
``log1p(count)``. Model: MLlib ``GBTRegressor`` in a ``Pipeline`` (distributed
tree building). Prediction: cluster x hour-offset grid, history lookups with
fallbacks, ensemble ``w * history + (1 - w) * expm1(model)``, band +- the
cluster's in-sample mean absolute error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions import scalar as S
from hotzone.operators.aggregates import cluster_profile, hist_means, hourly_counts, mae
from hotzone.operators.ranking import latest_global, top_n
from hotzone.session import saved


def forecast_features(features: DataFrame) -> DataFrame:
    """Training rows (J1 features): hourly counts with history means, cluster
    profile and cyclic hour; the label is ``log1p(violation_count)``."""
    hourly = hourly_counts(features)
    return training_rows(hourly, *hist_means(hourly), cluster_profile(features))


def training_rows(hourly: DataFrame, by_dow: DataFrame, by_hour: DataFrame, prof: DataFrame) -> DataFrame:
    """Hourly counts with their lookups and the label."""
    t = (hourly.join(by_dow, ["cluster", "hour", "dow_num"], "left")
         .join(by_hour, ["cluster", "hour"], "left")
         .join(prof, "cluster", "left")
         .withColumn("hour_sin", S.hour_sin("hour"))
         .withColumn("hour_cos", S.hour_cos("hour")))
    return t.withColumn("label", F.log1p(F.col("violation_count").cast("double")))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=P.FORECAST_FEATURES, outputCol="features", handleInvalid="keep")


def _filled(df: DataFrame) -> DataFrame:
    """Null features become 0 (as the original fills before fitting)."""
    return df.fillna(0, subset=P.FORECAST_FEATURES)


_TABLES = ("by_dow", "by_hour", "profile", "residuals", "train")


@dataclass
class ForecastModel:
    model: PipelineModel | None
    by_dow: DataFrame
    by_hour: DataFrame
    profile: DataFrame
    residuals: DataFrame  # cluster, pred_mae
    train: DataFrame      # training rows with predictions

    def save(self, path: str) -> None:
        """MLlib persistence for the model, Parquet for the lookup tables."""
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        for name in _TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, with_model: bool = True) -> "ForecastModel":
        model = PipelineModel.load(f"{path}/model") if with_model else None
        return ForecastModel(model, *(spark.read.parquet(f"{path}/{n}") for n in _TABLES))


def train_forecast(features: DataFrame, max_iter: int = P.GBT_MAX_ITER, max_depth: int = P.GBT_MAX_DEPTH,
                   step: float = P.GBT_STEP, subsample: float = P.GBT_SUBSAMPLE, seed: int = P.GBT_SEED,
                   use_model: bool = True) -> ForecastModel:
    """Fit the forecaster (J1). ``use_model=False`` keeps history only (no GBT).

    The hourly table is written once (one row per zone and hour with records);
    training, lookups and residuals read that copy.
    """
    hourly = saved(hourly_counts(features), "hourly")
    by_dow, by_hour = (saved(t, n) for t, n in zip(hist_means(hourly), ("by-dow", "by-hour")))
    prof = saved(cluster_profile(features), "profile")
    train = saved(_filled(training_rows(hourly, by_dow, by_hour, prof)), "train")
    hist_pred = F.coalesce("hist_mean_violations", "hist_mean_ch")
    model = None
    if use_model:
        gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                           stepSize=step, subsamplingRate=subsample, seed=seed)
        model = Pipeline(stages=[_assembler(), gbt]).fit(train)
        scored = model.transform(train).withColumn("gbr_pred", F.expm1("prediction")).drop("features")
        pred = F.col("gbr_pred")
    else:
        scored = train
        pred = hist_pred
    scored = scored.withColumn("model_pred", pred).withColumn("hist_pred", hist_pred)
    residuals = mae(scored, "violation_count", "model_pred", ["cluster"]).withColumnRenamed("mae", "pred_mae")
    return ForecastModel(model, by_dow, by_hour, prof, residuals, scored)


def forecast_quality(fm: ForecastModel, history_weight: float = P.HISTORY_WEIGHT) -> DataFrame:
    """In-sample MAE of the model and of the ensemble."""
    t = fm.train.withColumn("ens", F.lit(history_weight) * F.col("hist_pred")
                            + F.lit(1.0 - history_weight) * F.col("model_pred"))
    return t.agg(F.avg(F.abs(F.col("violation_count") - F.col("model_pred"))).alias("mae_model"),
                 F.avg(F.abs(F.col("violation_count") - F.col("ens"))).alias("mae_ensemble"))


def importances(fm: ForecastModel, minimum: float = P.IMPORTANCE_MIN) -> DataFrame:
    """Feature importances above ``minimum``, largest first (D16). The vector
    has one entry per feature (12 values) and comes from the driver-side model."""
    spark = fm.by_dow.sparkSession
    imp = fm.model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(P.FORECAST_FEATURES, imp) if v > minimum]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc())


def forecast_grid(clusters: DataFrame, as_of, hours: int = P.FORECAST_HOURS) -> DataFrame:
    """Cluster x hour offset 0..hours-1 with the target time and calendar.
    The offsets are an exploded literal array: no join."""
    t = F.col("target_ts")
    g = (clusters.select("cluster").withColumn("hour_offset", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
         .withColumn("forecast_at", S.ts_lit(as_of))
         .withColumn("target_ts", F.col("forecast_at") + F.make_interval(hours=F.col("hour_offset"))))
    return (g.withColumn("hour", F.hour(t)).withColumn("dow_num", S.weekday_num(t))
            .withColumn("month", F.month(t))
            .withColumn("is_weekend", (S.weekday_num(t) >= 5).cast("int"))
            .withColumn("is_peak", S.is_peak(F.hour(t)).cast("int"))
            .withColumn("target_datetime", F.date_format(t, "yyyy-MM-dd HH:mm"))
            .withColumn("hour_sin", S.hour_sin("hour")).withColumn("hour_cos", S.hour_cos("hour")))


def hist_lookup(grid: DataFrame, by_dow: DataFrame, by_hour: DataFrame) -> DataFrame:
    """(cluster, hour, dow) mean, else (cluster, hour) mean, else 1.0."""
    g = grid.join(by_dow, ["cluster", "hour", "dow_num"], "left").join(by_hour, ["cluster", "hour"], "left")
    return (g.withColumn("hist_mean_violations",
                         F.coalesce("hist_mean_violations", "hist_mean_ch", F.lit(P.DEFAULT_HISTORY)))
            .withColumn("hist_mean_ch", F.coalesce("hist_mean_ch", F.lit(P.DEFAULT_HISTORY))))


def cluster_features(clusters: DataFrame, profile: DataFrame, residuals: DataFrame) -> DataFrame:
    """Cluster-level features with defaults 1, 1, 0 and MAE 2 (C11)."""
    c = clusters.select("cluster").join(profile, "cluster", "left").join(residuals, "cluster", "left")
    return c.fillna({"cluster_avg_impact": P.DEFAULT_CLUSTER_IMPACT, "cluster_avg_lanes": P.DEFAULT_CLUSTER_LANES,
                     "cluster_total_log": P.DEFAULT_CLUSTER_LOG, "pred_mae": P.DEFAULT_PRED_MAE})


FORECAST_COLUMNS = ["cluster", "forecast_at", "hour_offset", "target_datetime", "predicted_violations",
                    "confidence_low", "confidence_high", "zone_name", "police_station"]


def forecast(fm: ForecastModel, clusters: DataFrame, as_of, meta: DataFrame | None = None,
             hours: int = P.FORECAST_HOURS, history_weight: float = P.HISTORY_WEIGHT) -> DataFrame:
    """Predictions for the next ``hours`` hours of every cluster."""
    grid = forecast_grid(clusters, as_of, hours)
    x = hist_lookup(grid, fm.by_dow, fm.by_hour).join(cluster_features(clusters, fm.profile, fm.residuals),
                                                      "cluster", "left")
    if fm.model is not None and history_weight < 1.0:
        x = fm.model.transform(_filled(x)).withColumn("model_pred", F.expm1("prediction")).drop("features", "prediction")
        pred = F.lit(history_weight) * F.col("hist_mean_violations") + F.lit(1.0 - history_weight) * F.col("model_pred")
    else:
        pred = F.col("hist_mean_violations")
    x = x.withColumn("_p", F.greatest(F.lit(0.0), pred))
    x = (x.withColumn("predicted_violations", S.r1("_p"))
         .withColumn("confidence_low", S.r1(F.greatest(F.lit(0.0), F.col("_p") - F.col("pred_mae"))))
         .withColumn("confidence_high", S.r1(F.col("_p") + F.col("pred_mae"))))
    if meta is not None:
        x = x.join(meta.select("cluster", "zone_name", "police_station").dropDuplicates(["cluster"]), "cluster", "left")
    else:
        x = x.withColumn("zone_name", F.lit(None).cast("string")).withColumn("police_station", F.lit(None).cast("string"))
    x = x.fillna({"zone_name": P.UNKNOWN, "police_station": P.UNKNOWN})
    return x.select(*FORECAST_COLUMNS)


def validation_candidates(fc, scores, n: int = 3):
    """Top n next-hour predictions of the newest run with the zone's current
    daily rate and score (C16)."""
    f = latest_global(fc, "forecast_at").filter(F.col("hour_offset") == 1)
    s = latest_global(scores, "recalculated_at").select("cluster", "daily_rate", "congestion_score")
    return top_n(f.join(s, "cluster", "left"), ["-predicted_violations", "cluster"], n)


def validate(cands):
    """Rule-based validation of candidates (B32): status and a one-line rationale."""
    st = S.plausibility()
    return cands.select("cluster", "forecast_at", "hour_offset", st.alias("validation_status"),
                        F.when(st == "Suspect", "one hour predicts over half the daily rate")
                        .otherwise("within the zone's daily rate").alias("llm_rationale"))
