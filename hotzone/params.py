"""Parameters of the scoring model.

Everything in the block marked FIXED VALUES must equal the behaviour being
rebuilt, so results match: lookup tables, weights, thresholds and labels.
All operators take these as defaults and accept overrides.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the original application's constants)
# ---------------------------------------------------------------------------

# Bounding box of the city, inclusive on all four sides.
BOX = {"lat_min": 12.75, "lat_max": 13.15, "lon_min": 77.35, "lon_max": 77.85}

# Mean earth radius used by the haversine metric, metres.
EARTH_RADIUS_M = 6371000.0

# Validation status -> weight; any other value (and null) -> 1.0.
STATUS_WEIGHT = {
    "approved": 1.5,
    "rejected": 0.0,
    "processing": 0.8,
    "duplicate": 0.3,
}
STATUS_WEIGHT_DEFAULT = 1.0

# Flag "sent to the city traffic system" -> weight; null stays null.
FLAG_WEIGHT_TRUE = 1.2
FLAG_WEIGHT_FALSE = 0.9

# Violation label -> severity; unknown labels and no labels -> 1.0.
LABEL_SEVERITY = {
    "PARKING IN A MAIN ROAD": 3.0,
    "DOUBLE PARKING": 3.0,
    "PARKING OPPOSITE TO ANOTHER PARKED VEHICLE": 2.5,
    "PARKING NEAR ROAD CROSSING": 2.2,
    "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 2.2,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 2.0,
    "NO PARKING": 2.0,
    "PARKING OTHER THAN BUS STOP": 1.8,
    "H T V PROHIBITED": 1.8,
    "WRONG PARKING": 1.5,
    "PARKING ON FOOTPATH": 1.2,
}
LABEL_SEVERITY_DEFAULT = 1.0

# Each label beyond the first adds this much to the compound score.
COMPOUND_STEP = 0.3

# Vehicle type -> lanes blocked; unknown -> 1.0.
VEHICLE_LANES = {
    "SCOOTER": 0.3,
    "MOTOR CYCLE": 0.3,
    "MOPED": 0.3,
    "CAR": 1.0,
    "JEEP": 1.0,
    "PASSENGER AUTO": 0.8,
    "GOODS AUTO": 0.8,
    "VAN": 1.5,
    "TEMPO": 1.5,
    "LGV": 1.5,
    "MAXI-CAB": 1.8,
    "PRIVATE BUS": 2.5,
    "BUS (BMTC/KSRTC)": 2.5,
    "LORRY/GOODS VEHICLE": 2.5,
    "HGV": 2.5,
    "TANKER": 3.0,
}
VEHICLE_LANES_DEFAULT = 1.0

# A device with at least this many rows is a fixed camera.
FIXED_CAMERA_MIN_ROWS = 200

# Peak hours: [0, 6) and [19, 24).
PEAK_BEFORE_HOUR = 6
PEAK_FROM_HOUR = 19

# Junction sentinel, compared after trimming; separator of the short label.
NO_JUNCTION = "No Junction"
JUNCTION_SEPARATOR = " - "

# Density clustering and centroid assignment.
DBSCAN_EPS_M = 150.0
DBSCAN_MIN_SAMPLES = 20
DBSCAN_SAMPLE_N = 60000
DBSCAN_SEED = 42
ASSIGN_MAX_M = 400.0

# Score weights, batch version (sum to 1) and live version.
BATCH_WEIGHTS = [
    ("c_impact", 0.30),
    ("c_lanes", 0.15),
    ("c_peak", 0.15),
    ("c_consistency", 0.15),
    ("c_persistence", 0.10),
    ("c_official", 0.10),
    ("c_compound", 0.05),
]
LIVE_WEIGHTS = [
    ("c_impact", 0.28),
    ("c_lanes", 0.28),
    ("c_peak", 0.18),
    ("c_consistency", 0.20),
    ("c_persistence", 0.05),
    ("c_official", 0.01),
    ("c_compound", 0.00),
]
OFFICIAL_APPROVED_SHARE = 0.6
OFFICIAL_FLAG_SHARE = 0.4
LANES_FULL_ROAD = 4.0

# Tiers on the 0..100 score.
TIER_CRITICAL = 75.0
TIER_HIGH = 50.0
TIER_MEDIUM = 25.0

# Shift labels: (threshold on peak share, label), first match wins.
SHIFT_BATCH = [
    (0.85, "Late night (11pm–4am)"),
    (0.60, "Evening + night (7pm–midnight)"),
]
SHIFT_BATCH_DEFAULT = "Mixed / daytime"
SHIFT_LIVE = [
    (0.75, "Late night / early morning (7pm–6am)"),
    (0.40, "Evening + night (7pm–midnight)"),
]
SHIFT_LIVE_DEFAULT = "Daytime (6am–7pm)"

WEEKEND_BIAS_SHARE = 0.55
WEEKEND_HEAVY = "Weekend-heavy"
WEEKDAY_UNIFORM = "Weekday-uniform"

# Alert severity for (previous tier, new tier); other pairs -> info.
ALERT_SEVERITY = {
    ("LOW", "MEDIUM"): "info",
    ("MEDIUM", "HIGH"): "warning",
    ("HIGH", "CRITICAL"): "urgent",
    ("CRITICAL", "HIGH"): "resolved",
    ("HIGH", "MEDIUM"): "resolved",
    ("MEDIUM", "LOW"): "resolved",
    ("CRITICAL", "MEDIUM"): "resolved",
    ("CRITICAL", "LOW"): "resolved",
}
ALERT_SEVERITY_DEFAULT = "info"
TOP_ENTRANTS_N = 10

# Rate anomalies.
Z_MODERATE = 2.0
Z_SEVERE = 3.0
Z_EXTREME = 4.5
STD_FLOOR = 0.5
STD_SINGLE_DAY = 1.0
RATE_SPIKE_SHARE = 0.25

# Forecast model and ensemble.
FORECAST_FEATURES = [
    "hour",
    "dow_num",
    "month",
    "is_weekend",
    "is_peak",
    "hist_mean_violations",
    "hist_mean_ch",
    "cluster_avg_impact",
    "cluster_avg_lanes",
    "cluster_total_log",
    "hour_sin",
    "hour_cos",
]
GBT_MAX_ITER = 200
GBT_MAX_DEPTH = 4
GBT_STEP = 0.06
GBT_SUBSAMPLE = 0.8
GBT_SEED = 42
HISTORY_WEIGHT = 0.3
FORECAST_HOURS = 6
DEFAULT_CLUSTER_IMPACT = 1.0
DEFAULT_CLUSTER_LANES = 1.0
DEFAULT_CLUSTER_LOG = 0.0
DEFAULT_PRED_MAE = 2.0
DEFAULT_HISTORY = 1.0
IMPORTANCE_MIN = 0.005

# Serving.
HEAT_LIMIT = 80000
HEAT_MIN_IMPACT = 4.0
FORECAST_BAND_RED = 20.0
FORECAST_BAND_ORANGE = 10.0
PATROL_ROWS = 15.0
UNKNOWN = "Unknown"
PLAUSIBLE_SHARE = 0.5
PLAUSIBLE_SCORE = 90.0

# Retention of score history.
SCORE_RETENTION = "6 hours"
