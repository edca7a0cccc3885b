"""Table schemas (explicit StructTypes; nothing is inferred)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _s(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# Raw violation record (CSV or Parquet source).
RAW_EVENTS = _s(
    ("id", LongType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("created_datetime", TimestampType()),
    ("modified_datetime", TimestampType()),
    ("validation_timestamp", TimestampType()),
    ("vehicle_type", StringType()),
    ("updated_vehicle_type", StringType()),
    ("violation_type", StringType()),
    ("validation_status", StringType()),
    ("data_sent_to_scita", BooleanType()),
    ("device_id", StringType()),
    ("junction_name", StringType()),
    ("police_station", StringType()),
)

# Columns the feature step adds to a raw record.
FEATURE_COLUMNS = _s(
    ("final_vehicle_type", StringType()),
    ("validation_weight", DoubleType()),
    ("scita_weight", DoubleType()),
    ("labels", ArrayType(StringType())),
    ("vtype_severity", DoubleType()),
    ("compound_score", DoubleType()),
    ("lanes_blocked", DoubleType()),
    ("device_type", StringType()),
    ("impact", DoubleType()),
    ("hour", IntegerType()),
    ("dow", StringType()),
    ("month", IntegerType()),
    ("date", DateType()),
    ("week", IntegerType()),
    ("is_peak", BooleanType()),
    ("is_weekend", BooleanType()),
)

# Live event log (one row per id).
VIOLATIONS = _s(
    ("id", LongType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("vehicle_type", StringType()),
    ("final_vehicle_type", StringType()),
    ("violation_type", StringType()),
    ("police_station", StringType()),
    ("junction_name", StringType()),
    ("hour", IntegerType()),
    ("is_peak", BooleanType()),
    ("lanes_blocked", DoubleType()),
    ("vtype_severity", DoubleType()),
    ("compound_score", DoubleType()),
    ("impact", DoubleType()),
    ("validation_weight", DoubleType()),
    ("scita_weight", DoubleType()),
    ("cluster", IntegerType()),
    ("created_datetime", TimestampType()),
    ("ingested_at", TimestampType()),
)

CLUSTER_SCORES = _s(
    ("cluster", IntegerType()),
    ("recalculated_at", TimestampType()),
    ("violation_count", LongType()),
    ("total_impact", DoubleType()),
    ("avg_lanes_blocked", DoubleType()),
    ("peak_pct", DoubleType()),
    ("active_days", LongType()),
    ("active_weeks", LongType()),
    ("approved_pct", DoubleType()),
    ("scita_pct", DoubleType()),
    ("compound_pct", DoubleType()),
    ("congestion_score", DoubleType()),
    ("risk_tier", StringType()),
    ("zone_name", StringType()),
    ("police_station", StringType()),
    ("daily_rate", DoubleType()),
    ("blockage_pct", DoubleType()),
    ("enforcement_shift", StringType()),
)

ALERTS = _s(
    ("id", LongType()),
    ("cluster", IntegerType()),
    ("zone_name", StringType()),
    ("police_station", StringType()),
    ("previous_tier", StringType()),
    ("new_tier", StringType()),
    ("congestion_score", DoubleType()),
    ("triggered_at", TimestampType()),
    ("severity", StringType()),
)

ANOMALIES = _s(
    ("id", LongType()),
    ("cluster", IntegerType()),
    ("zone_name", StringType()),
    ("police_station", StringType()),
    ("current_rate", DoubleType()),
    ("baseline_rate", DoubleType()),
    ("z_score", DoubleType()),
    ("anomaly_type", StringType()),
    ("severity", StringType()),
    ("detected_at", TimestampType()),
)

# Acknowledgements are an append-only log: one row per acknowledged id.
ACKS = _s(("id", LongType()), ("acknowledged_at", TimestampType()))

INGESTION_STATE = _s(
    ("last_ingested_datetime", TimestampType()),
    ("last_ingested_id", LongType()),
    ("total_rows_ingested", LongType()),
)

CLUSTER_FORECASTS = _s(
    ("cluster", IntegerType()),
    ("forecast_at", TimestampType()),
    ("hour_offset", IntegerType()),
    ("target_datetime", StringType()),
    ("predicted_violations", DoubleType()),
    ("confidence_low", DoubleType()),
    ("confidence_high", DoubleType()),
    ("zone_name", StringType()),
    ("police_station", StringType()),
)

# Never created by the original code but read and written there; defined here.
FORECAST_VALIDATIONS = _s(
    ("cluster", IntegerType()),
    ("forecast_at", TimestampType()),
    ("hour_offset", IntegerType()),
    ("validation_status", StringType()),
    ("llm_rationale", StringType()),
)
