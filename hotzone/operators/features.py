"""Row cleaning and weighting: raw records -> feature rows.

All of it is one map-only stage except the device class, which needs a
count per device (one partial/final aggregation and a size-checked
broadcast join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions import scalar as S


def geo_filter(df: DataFrame, box: dict | None = None, lat="latitude", lon="longitude") -> DataFrame:
    """Inclusive bounding box; rows with null coordinates drop out (B1)."""
    b = box or P.BOX
    return df.filter(F.col(lat).between(b["lat_min"], b["lat_max"]) & F.col(lon).between(b["lon_min"], b["lon_max"]))


def add_weights(df: DataFrame) -> DataFrame:
    """final vehicle type, status and flag weights."""
    return df.select(
        "*",
        S.final_vehicle_type().alias("final_vehicle_type"),
        S.status_weight().alias("validation_weight"),
        S.flag_weight().alias("scita_weight"),
    )


def drop_rejected(df: DataFrame) -> DataFrame:
    """Keep rows whose status weight is positive."""
    return df.filter(F.col("validation_weight") > 0)


def add_label_scores(df: DataFrame) -> DataFrame:
    """labels, severity, compound score and lanes blocked."""
    df = df.withColumn("labels", S.labels())
    return df.select(
        "*",
        S.severity().alias("vtype_severity"),
        S.compound().alias("compound_score"),
        S.lanes().alias("lanes_blocked"),
    )


def label_counts(df: DataFrame) -> DataFrame:
    """One row per label occurrence, counted per label."""
    return (df.select(F.explode(S.labels()).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def device_class(df: DataFrame, threshold: int = P.FIXED_CAMERA_MIN_ROWS, device="device_id") -> DataFrame:
    """``fixed_camera`` for devices with at least ``threshold`` rows, else ``patrol``;
    a null device is a patrol (B11).

    The per-device count is a partial+final aggregation (map-side combine, so a
    device holding a third of all rows costs one counter per task), filtered to
    fixed cameras and joined back on the device. AQE broadcasts the cameras
    when they prove few at run time and splits a hot device otherwise; no
    Window over the device (that would put a hot device in one task).
    """
    fixed = (df.filter(F.col(device).isNotNull()).groupBy(device).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") >= threshold).select(device, F.lit(True).alias("_fixed")))
    out = df.join(fixed, on=device, how="left")
    return out.withColumn("device_type", F.when(F.col("_fixed"), "fixed_camera").otherwise("patrol")).drop("_fixed")


def add_impact_and_calendar(df: DataFrame, ts="created_datetime") -> DataFrame:
    """Impact (B12) and calendar columns."""
    cal = S.calendar_columns(ts)
    return df.select("*", S.impact().alias("impact"), *[c.alias(n) for n, c in cal.items()])


def build_features(raw: DataFrame, box: dict | None = None,
                   device_threshold: int = P.FIXED_CAMERA_MIN_ROWS) -> DataFrame:
    """Raw records -> feature rows (B16): filter, weights, labels, device class,
    impact, calendar. Filters come first so Catalyst pushes them to the scan."""
    df = geo_filter(raw, box)
    df = drop_rejected(add_weights(df))
    df = add_label_scores(df)
    df = device_class(df, device_threshold)
    return add_impact_and_calendar(df)


def clustered(df: DataFrame, col: str = "cluster") -> DataFrame:
    """Rows that belong to a zone: cluster not -1 and not null."""
    return df.filter(F.col(col) != -1)


def with_given_zones(features: DataFrame, zone_col: str = "true_zone") -> DataFrame:
    """Use a zone column that is already known (for example from the data's
    generator) as the cluster, instead of running the density clustering."""
    return features.withColumn("cluster", F.col(zone_col).cast("int"))
