"""Hand cases for the scalar operators (one per operator)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hotzone.functions import scalar as S


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_labels(spark):
    got = one(spark, [(None,), ("[]",), ('["A","A"]',)], "v string", S.labels("v"))
    assert got == [[], [], ["A", "A"]]


def test_compound(spark):
    got = one(spark, [([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "l array<string>", S.compound("l"))
    assert [round(x, 10) for x in got] == [0.7, 1.0, 1.3, 1.6]


def test_severity(spark):
    got = one(spark, [([],), (["UNKNOWN"],), (["NO PARKING", "DOUBLE PARKING"],), (["UNKNOWN", "PARKING ON FOOTPATH"],)],
              "l array<string>", S.severity("l"))
    assert got == [1.0, 1.0, 3.0, 1.2]


def test_status_and_flag_weights(spark):
    got = one(spark, [("approved",), ("rejected",), ("processing",), ("duplicate",), ("other",), (None,)],
              "s string", S.status_weight("s"))
    assert got == [1.5, 0.0, 0.8, 0.3, 1.0, 1.0]
    got = one(spark, [(True,), (False,), (None,)], "b boolean", S.flag_weight("b"))
    assert got == [1.2, 0.9, None]


def test_impact_null_flag(spark):
    df = spark.createDataFrame([(2.0, 1.0, 1.0, 1.5, None)], "a double, b double, c double, d double, e double")
    assert df.select(S.impact("a", "b", "c", "d", "e")).first()[0] is None


def test_risk_tier(spark):
    got = one(spark, [(75.0,), (74.9,), (50.0,), (25.0,), (24.9,), (None,)], "s double", S.risk_tier("s"))
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]


def test_shift_labels(spark):
    b = one(spark, [(0.85,), (0.86,)], "p double", S.shift_label("p", "batch"))
    assert b == ["Evening + night (7pm–midnight)", "Late night (11pm–4am)"]
    lv = one(spark, [(0.75,), (0.76,)], "p double", S.shift_label("p", "live"))
    assert lv == ["Evening + night (7pm–midnight)", "Late night / early morning (7pm–6am)"]


def test_is_peak(spark):
    got = one(spark, [(h,) for h in (0, 5, 6, 18, 19, 23)], "h int", S.is_peak("h"))
    assert got == [True, True, False, False, True, True]


def test_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 1),)], "d date")
    assert [r[0] for r in df.select(F.weekofyear("d")).collect()] == [52, 1]
    assert [r[0] for r in df.select(S.weekday_num("d")).collect()] == [6, 0]


def test_half_even_rounding(spark):
    got = one(spark, [(0.25,), (0.35,), (2.25,), (-0.25,)], "x double", S.r1("x"))
    assert got == [0.2, 0.4, 2.2, -0.2]


def test_alert_severity(spark):
    rows = [("LOW", "MEDIUM"), ("MEDIUM", "HIGH"), ("HIGH", "CRITICAL"), ("CRITICAL", "LOW"), ("HIGH", "LOW"),
            ("NONE", "HIGH")]
    got = one(spark, rows, "a string, b string", S.alert_severity("a", "b"))
    assert got == ["info", "warning", "urgent", "resolved", "info", "info"]


def test_anomaly_classes(spark):
    got = one(spark, [(2.0,), (-3.0,), (4.5,)], "z double", F.concat(S.anomaly_type("z"), F.lit("/"), S.anomaly_severity("z")))
    assert got == ["spike/moderate", "drop/severe", "spike/extreme"]


def test_junction_label_and_zone_name(spark):
    got = one(spark, [("BTP01 - Zone 1 Junction",), ("Circle 3",)], "j string", S.short_junction("j"))
    assert got == ["Zone 1 Junction", "Circle 3"]
    got = one(spark, [("No Junction ",), (None,), ("X",)], "j string", S.named_junction("j"))
    assert got == [None, None, "X"]


@pytest.mark.parametrize("d_m", [0.0, 150.0, 1000.0])
def test_haversine(spark, d_m):
    import math
    lat2 = 12.9 + d_m / (6371000.0 * math.pi / 180.0)
    got = one(spark, [(12.9, 77.5, lat2, 77.5)], "a double, b double, c double, d double",
              S.haversine_m("a", "b", "c", "d"))[0]
    assert abs(got - d_m) < 1e-6
