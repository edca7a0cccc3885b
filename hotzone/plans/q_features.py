"""Registered queries: scans, defaults, scalar operators and feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotzone.functions import scalar as S
from hotzone.operators import features as FT
from hotzone.oracles import RAW, features_cte, r6, with_
from hotzone.plans.catalog import feats, fresh_feats, out, raw, register
from hotzone.schemas import RAW_EVENTS
from hotzone.session import scratch_path
from hotzone.sources.events import normalise_time, read_events, with_defaults

RAW_COLS = ["id", "latitude", "longitude", "created_datetime", "vehicle_type", "updated_vehicle_type",
            "violation_type", "validation_status", "data_sent_to_scita", "device_id", "junction_name",
            "police_station", "true_zone"]


@register("scan_events", with_(RAW) + """
SELECT id, """ + r6("latitude") + ", " + r6("longitude") + """, created_datetime, vehicle_type,
  updated_vehicle_type, violation_type, validation_status, data_sent_to_scita, device_id, junction_name,
  police_station, true_zone
FROM violations_raw""")
def q_scan_events(spark, sf):
    return out(raw(spark, sf).select(*RAW_COLS))


@register("scan_csv", with_(RAW) + """
SELECT id, """ + r6("latitude") + ", " + r6("longitude") + """, created_datetime, vehicle_type,
  updated_vehicle_type, violation_type, validation_status, data_sent_to_scita, device_id, junction_name,
  police_station
FROM violations_raw""")
def q_scan_csv(spark, sf):
    """Raw records laid out as CSV with a header and read by the typed scan."""
    path = scratch_path(spark, "raw-csv")
    src = raw(spark, sf)
    src = src.select(*[F.col(f.name) if f.name in src.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_EVENTS.fields])
    src.write.option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS") \
        .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return out(read_events(spark, path, fmt="csv", columns=[c for c in RAW_COLS if c != "true_zone"]))


@register("scan_pruned", with_(RAW) + """
SELECT id, """ + r6("latitude") + ", " + r6("longitude") + " FROM violations_raw")
def q_scan_pruned(spark, sf):
    return out(raw(spark, sf).select("id", "latitude", "longitude"))


@register("defaults", with_(RAW) + """
SELECT id, police_station, 1.0e0 AS validation_weight, 1.0e0 AS scita_weight, 1.0e0 AS lanes_blocked,
  1.0e0 AS vtype_severity, 1.0e0 AS compound_score, 1.0e0 AS impact
FROM violations_raw""")
def q_defaults(spark, sf):
    df = raw(spark, sf).select("id", "police_station")
    df = with_defaults(df, {"police_station": "never used", "validation_weight": 1.0, "scita_weight": 1.0,
                            "lanes_blocked": 1.0, "vtype_severity": 1.0, "compound_score": 1.0, "impact": 1.0})
    return out(df)


@register("normalise_time", with_(RAW) + """
SELECT id, CAST(t AS TIMESTAMP) AS created_datetime FROM (
  SELECT id, TRY_CAST(CASE WHEN validation_status = 'rejected' THEN 'n/a'
                         ELSE strftime(created_datetime, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS t
  FROM violations_raw) WHERE t IS NOT NULL""")
def q_normalise_time(spark, sf):
    text = F.when(F.col("validation_status") == "rejected", F.lit("n/a")).otherwise(
        F.date_format("created_datetime", "yyyy-MM-dd HH:mm:ss"))
    df = raw(spark, sf).select("id", text.alias("created_datetime"))
    return out(normalise_time(df, "created_datetime"))


BOXED = """FROM violations_raw
WHERE latitude BETWEEN 12.75e0 AND 13.15e0 AND longitude BETWEEN 77.35e0 AND 77.85e0"""


@register("geo_filter", with_(RAW) + "\nSELECT id, " + r6("latitude") + ", " + r6("longitude") + "\n" + BOXED)
def q_geo_filter(spark, sf):
    return out(FT.geo_filter(raw(spark, sf)).select("id", "latitude", "longitude"))


@register("final_vehicle", with_(features_cte()) + """
SELECT id, vehicle_type, updated_vehicle_type, final_vehicle_type FROM features""")
def q_final_vehicle(spark, sf):
    return feats(spark, sf).select("id", "vehicle_type", "updated_vehicle_type", "final_vehicle_type")


@register("status_weight", with_(RAW) + """
SELECT id, validation_status,
  CASE validation_status WHEN 'approved' THEN 1.5e0 WHEN 'rejected' THEN 0e0
    WHEN 'processing' THEN 0.8e0 WHEN 'duplicate' THEN 0.3e0 ELSE 1.0e0 END AS validation_weight
""" + BOXED)
def q_status_weight(spark, sf):
    df = FT.geo_filter(raw(spark, sf))
    return out(df.select("id", "validation_status", S.status_weight().alias("validation_weight")))


@register("drop_rejected", with_(features_cte()) + "\nSELECT id, validation_status FROM features")
def q_drop_rejected(spark, sf):
    df = FT.drop_rejected(FT.add_weights(FT.geo_filter(raw(spark, sf))))
    return df.select("id", "validation_status")


@register("flag_weight", with_(features_cte()) + """
SELECT id, data_sent_to_scita, """ + r6("scita_weight") + " FROM features")
def q_flag_weight(spark, sf):
    return out(feats(spark, sf).select("id", "data_sent_to_scita", "scita_weight"))


@register("labels", with_(features_cte()) + """
SELECT id, array_to_string(labels, '|') AS labels_text, CAST(len(labels) AS INTEGER) AS n_labels FROM features""")
def q_labels(spark, sf):
    df = feats(spark, sf)
    return df.select("id", F.array_join("labels", "|").alias("labels_text"), F.size("labels").alias("n_labels"))


@register("label_counts", with_(features_cte()) + """
SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM features) GROUP BY label""")
def q_label_counts(spark, sf):
    f = feats(spark, sf)
    return f.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("severity", with_(features_cte()) + "\nSELECT id, violation_type, " + r6("vtype_severity") + " FROM features")
def q_severity(spark, sf):
    return out(feats(spark, sf).select("id", "violation_type", "vtype_severity"))


@register("compound", with_(features_cte()) + "\nSELECT id, violation_type, " + r6("compound_score") + " FROM features")
def q_compound(spark, sf):
    return out(feats(spark, sf).select("id", "violation_type", "compound_score"))


@register("lanes", with_(features_cte()) + "\nSELECT id, final_vehicle_type, " + r6("lanes_blocked") + " FROM features")
def q_lanes(spark, sf):
    return out(feats(spark, sf).select("id", "final_vehicle_type", "lanes_blocked"))


@register("device_class", with_(features_cte()) + "\nSELECT id, device_id, device_type FROM features")
def q_device_class(spark, sf):
    return feats(spark, sf).select("id", "device_id", "device_type")


@register("impact", with_(features_cte()) + "\nSELECT id, " + r6("impact") + " FROM features")
def q_impact(spark, sf):
    return out(feats(spark, sf).select("id", "impact"))


@register("calendar", with_(features_cte()) + """
SELECT id, hour, dow, month, date, week, is_peak, is_weekend FROM features""")
def q_calendar(spark, sf):
    return feats(spark, sf).select("id", "hour", "dow", "month", "date", "week", "is_peak", "is_weekend")


@register("is_peak", with_(features_cte()) + "\nSELECT id, hour, is_peak FROM features")
def q_is_peak(spark, sf):
    return feats(spark, sf).select("id", "hour", "is_peak")


@register("is_weekend", with_(features_cte()) + "\nSELECT id, date, is_weekend FROM features")
def q_is_weekend(spark, sf):
    return feats(spark, sf).select("id", "date", "is_weekend")


FEATURE_COLS = ["id", "latitude", "longitude", "created_datetime", "final_vehicle_type", "validation_weight",
                "scita_weight", "vtype_severity", "compound_score", "lanes_blocked", "device_type", "impact",
                "hour", "dow", "month", "date", "week", "is_peak", "is_weekend", "cluster"]


@register("features", with_(features_cte()) + """
SELECT id, """ + ", ".join(r6(c) for c in ["latitude", "longitude"]) + """, created_datetime, final_vehicle_type,
  """ + ", ".join(r6(c) for c in ["validation_weight", "scita_weight", "vtype_severity", "compound_score",
                                  "lanes_blocked"]) + """, device_type, """ + r6("impact") + """,
  hour, dow, month, date, week, is_peak, is_weekend, cluster
FROM features""")
def q_features(spark, sf):
    return out(fresh_feats(spark, sf).select(*FEATURE_COLS))


@register("hour_cyclic", with_(features_cte()) + """
SELECT id, hour, """ + r6("sin(2e0 * pi() * hour / 24e0)", "hour_sin") + ", "
          + r6("cos(2e0 * pi() * hour / 24e0)", "hour_cos") + " FROM features")
def q_hour_cyclic(spark, sf):
    f = feats(spark, sf)
    return out(f.select("id", "hour", S.hour_sin().alias("hour_sin"), S.hour_cos().alias("hour_cos")))
