"""Scalar column expressions. All are built-in Spark expressions (whole-stage codegen);
none is a Python UDF."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotzone import params as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_lit(value) -> Column:
    """A timestamp literal read in the session time zone (independent of the
    Python process's zone): datetimes go through ISO text."""
    if hasattr(value, "isoformat"):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def lit_map(mapping: dict) -> Column:
    """A literal MapType column, e.g. for lookups that fall back to a default."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(col, mapping: dict, default) -> Column:
    """``mapping[col]`` with a default for missing keys and null input."""
    return F.coalesce(F.try_element_at(lit_map(mapping), _c(col)), F.lit(default))


def r1(col) -> Column:
    """Round half to even at one decimal place, as NumPy does."""
    return F.rint(_c(col) * 10.0) / 10.0


def round_even(col, places: int) -> Column:
    scale = float(10**places)
    return F.rint(_c(col) * scale) / scale


# --- row weights -----------------------------------------------------------

def final_vehicle_type(updated="updated_vehicle_type", original="vehicle_type") -> Column:
    """The corrected vehicle type first (B2)."""
    return F.coalesce(_c(updated), _c(original))


def status_weight(col="validation_status", mapping=None, default=P.STATUS_WEIGHT_DEFAULT) -> Column:
    """Validation status -> weight."""
    return lookup(col, mapping or P.STATUS_WEIGHT, default)


def flag_weight(col="data_sent_to_scita") -> Column:
    """True 1.2, false 0.9, null stays null."""
    c = _c(col)
    return F.when(c, F.lit(P.FLAG_WEIGHT_TRUE)).when(~c, F.lit(P.FLAG_WEIGHT_FALSE))


def labels(col="violation_type") -> Column:
    """Quoted labels of a list-like text; null gives an empty array."""
    return F.coalesce(
        F.regexp_extract_all(_c(col), F.lit('"([^"]+)"'), 1),
        F.array().cast("array<string>"),
    )


def severity(labels_col="labels", mapping=None, default=P.LABEL_SEVERITY_DEFAULT) -> Column:
    """Largest label severity; unknown labels and no labels give the default.

    Written without a lambda (``transform`` is not whole-stage code-generated):
    the largest severity among known labels present, and the default when an
    unknown label is present or there is none.
    """
    table = mapping or P.LABEL_SEVERITY
    lab = _c(labels_col)
    known = [F.when(F.array_contains(lab, k), F.lit(float(v))) for k, v in table.items()]
    has_unknown = F.size(F.array_except(lab, F.array(*[F.lit(k) for k in table]))) > 0
    unknown = F.when(has_unknown, F.lit(float(default)))
    return F.coalesce(F.greatest(*known, unknown), F.lit(float(default)))


def compound(labels_col="labels", step=P.COMPOUND_STEP) -> Column:
    """``1 + step * (n - 1)``; no labels gives 0.7."""
    return F.lit(1.0) + (F.size(_c(labels_col)) - 1) * F.lit(step)


def lanes(col="final_vehicle_type", mapping=None, default=P.VEHICLE_LANES_DEFAULT) -> Column:
    """Lanes blocked by a vehicle type."""
    return lookup(col, mapping or P.VEHICLE_LANES, default)


def impact(sev="vtype_severity", ln="lanes_blocked", comp="compound_score",
           status="validation_weight", flag="scita_weight") -> Column:
    """Product of the five weights in a fixed order; null when the flag is null."""
    return _c(sev) * _c(ln) * _c(comp) * _c(status) * _c(flag)


# --- calendar --------------------------------------------------------------

def is_peak(hour_col="hour") -> Column:
    """Hours 0-5 and 19-23."""
    h = _c(hour_col)
    return (h < P.PEAK_BEFORE_HOUR) | (h >= P.PEAK_FROM_HOUR)


def weekday_num(ts_col) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts_col))


def is_weekend(ts_col="created_datetime") -> Column:
    """Saturday or Sunday."""
    return weekday_num(ts_col) >= 5


def calendar_columns(ts_col="created_datetime") -> dict[str, Column]:
    """hour, day name, month, date, ISO week, peak and weekend flags."""
    ts = _c(ts_col)
    return {
        "hour": F.hour(ts),
        "dow": F.date_format(ts, "EEEE"),
        "month": F.month(ts),
        "date": F.to_date(ts),
        "week": F.weekofyear(ts),
        "is_peak": is_peak(F.hour(ts)),
        "is_weekend": is_weekend(ts),
    }


def hour_sin(hour_col="hour") -> Column:
    return F.sin(F.lit(2.0 * math.pi) * _c(hour_col) / 24.0)


def hour_cos(hour_col="hour") -> Column:
    return F.cos(F.lit(2.0 * math.pi) * _c(hour_col) / 24.0)


# --- labels on scores ------------------------------------------------------

def risk_tier(score_col="congestion_score") -> Column:
    """>=75 CRITICAL, >=50 HIGH, >=25 MEDIUM, else (and null) LOW."""
    s = _c(score_col)
    return (
        F.when(s >= P.TIER_CRITICAL, "CRITICAL")
        .when(s >= P.TIER_HIGH, "HIGH")
        .when(s >= P.TIER_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def shift_label(peak_col="peak_pct", version: str = "batch") -> Column:
    """Enforcement shift from the peak share; two label sets."""
    rules, default = (P.SHIFT_BATCH, P.SHIFT_BATCH_DEFAULT) if version == "batch" else (P.SHIFT_LIVE, P.SHIFT_LIVE_DEFAULT)
    p = _c(peak_col)
    expr = None
    for threshold, label in rules:
        expr = F.when(p > threshold, label) if expr is None else expr.when(p > threshold, label)
    return expr.otherwise(default)


def weekend_bias(share_col="weekend_pct") -> Column:
    """Weekend-heavy above 0.55."""
    return F.when(_c(share_col) > P.WEEKEND_BIAS_SHARE, P.WEEKEND_HEAVY).otherwise(P.WEEKDAY_UNIFORM)


def short_junction(col) -> Column:
    """Text after the last separator."""
    return F.element_at(F.split(_c(col), P.JUNCTION_SEPARATOR), -1)


def named_junction(col="junction_name") -> Column:
    """The junction name unless it is the sentinel (after trimming); null stays null."""
    c = _c(col)
    return F.when(F.trim(c) != P.NO_JUNCTION, c)


def zone_name(junction_col="junction_label", station_col="police_station") -> Column:
    """Junction label, else ``<station> area``."""
    return F.coalesce(_c(junction_col), F.concat(_c(station_col), F.lit(" area")))


def anomaly_type(z_col="z") -> Column:
    return F.when(_c(z_col) > 0, "spike").otherwise("drop")


def anomaly_severity(z_col="z") -> Column:
    """abs(z) >= 4.5 extreme, >= 3 severe, else moderate."""
    a = F.abs(_c(z_col))
    return F.when(a >= P.Z_EXTREME, "extreme").when(a >= P.Z_SEVERE, "severe").otherwise("moderate")


def alert_severity(prev_col="previous_tier", new_col="new_tier") -> Column:
    """Severity of a tier change; pairs not in the table are info."""
    table = {f"{a}>{b}": v for (a, b), v in P.ALERT_SEVERITY.items()}
    key = F.concat(_c(prev_col), F.lit(">"), _c(new_col))
    return lookup(key, table, P.ALERT_SEVERITY_DEFAULT)


def forecast_band(pred_col="predicted_violations") -> Column:
    """>=20 red, >=10 orange, else green."""
    p = _c(pred_col)
    return F.when(p >= P.FORECAST_BAND_RED, "red").when(p >= P.FORECAST_BAND_ORANGE, "orange").otherwise("green")


def plausibility(pred_col="predicted_violations", rate_col="daily_rate", score_col="congestion_score") -> Column:
    """Suspect when one hour predicts over half the daily rate and the score is below 90."""
    suspect = (_c(pred_col) > _c(rate_col) * P.PLAUSIBLE_SHARE) & (_c(score_col) < P.PLAUSIBLE_SCORE)
    return F.when(suspect, "Suspect").otherwise("Valid")


# --- distance --------------------------------------------------------------

def haversine_m(lat1, lon1, lat2, lon2, radius=P.EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2.0), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2.0), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))
