"""Independent DuckDB SQL for the correctness check.

Each text starts from the driver's ``events`` view and restates the mapping
and the operator in plain SQL (CASE and literal numbers), so it does not
share code with the Spark side. Float literals carry ``e0`` so both engines
read them as DOUBLE. Doubles in outputs are rounded half-even to 6 places on
both sides; timestamps are returned without zone.
"""

from __future__ import annotations

DEVICE_T = 60  # device threshold used by the registered queries (no device reaches 200 here)

RAW = r"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
violations_raw AS (
  SELECT
    event_id AS id,
    12.77e0 + 0.09e0*(user_id % 4) + 0.0001e0*(k % 10)
      + CASE WHEN k >= 96 THEN 0.02e0 + 0.002e0*(event_id % 20) ELSE 0e0 END AS latitude,
    77.40e0 + 0.10e0*(user_id % 5) + 0.0001e0*floor(k/10.0e0)
      + CASE WHEN k >= 96 THEN 0.004e0*(event_id % 23) ELSE 0e0 END AS longitude,
    CAST(ts AS TIMESTAMP) AS created_datetime,
    CASE k % 6 WHEN 0 THEN 'SCOOTER' WHEN 1 THEN 'CAR' WHEN 2 THEN 'PASSENGER AUTO'
      WHEN 3 THEN 'MAXI-CAB' WHEN 4 THEN 'TANKER' ELSE 'CYCLE RICKSHAW' END AS vehicle_type,
    CASE WHEN k % 13 = 0 THEN 'HGV' END AS updated_vehicle_type,
    CASE k % 8 WHEN 0 THEN '["NO PARKING"]'
      WHEN 1 THEN '["WRONG PARKING","NO PARKING"]'
      WHEN 2 THEN '["PARKING IN A MAIN ROAD","DOUBLE PARKING","WRONG PARKING"]'
      WHEN 3 THEN '["PARKING ON FOOTPATH"]'
      WHEN 4 THEN '["DEFECTIVE NUMBER PLATE"]'
      WHEN 6 THEN '[]'
      WHEN 7 THEN '["DOUBLE PARKING","H T V PROHIBITED"]' END AS violation_type,
    CASE event_type WHEN 'click' THEN 'approved' WHEN 'error' THEN 'rejected'
      WHEN 'signup' THEN 'processing' WHEN 'view' THEN 'duplicate' END AS validation_status,
    CASE WHEN k % 7 = 0 THEN NULL ELSE k % 2 = 0 END AS data_sent_to_scita,
    CAST(user_id AS VARCHAR) AS device_id,
    CASE user_id % 4
      WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'No Junction' ELSE 'No Junction ' END
      WHEN 1 THEN 'BTP0' || CAST(user_id % 20 AS VARCHAR) || ' - Zone ' || CAST(user_id % 20 AS VARCHAR) || ' Junction'
      WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'Circle ' || CAST(user_id % 20 AS VARCHAR) ELSE 'No Junction' END
    END AS junction_name,
    CASE WHEN user_id % 20 = 19 THEN 'Unknown' ELSE 'PS' || CAST(user_id % 6 AS VARCHAR) END AS police_station,
    CAST(CASE WHEN k < 96 THEN user_id % 20 ELSE -1 END AS INTEGER) AS true_zone
  FROM ev
)"""

SEVERITY_CASE = """CASE x
      WHEN 'PARKING IN A MAIN ROAD' THEN 3.0e0 WHEN 'DOUBLE PARKING' THEN 3.0e0
      WHEN 'PARKING OPPOSITE TO ANOTHER PARKED VEHICLE' THEN 2.5e0
      WHEN 'PARKING NEAR ROAD CROSSING' THEN 2.2e0 WHEN 'PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS' THEN 2.2e0
      WHEN 'PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC' THEN 2.0e0 WHEN 'NO PARKING' THEN 2.0e0
      WHEN 'PARKING OTHER THAN BUS STOP' THEN 1.8e0 WHEN 'H T V PROHIBITED' THEN 1.8e0
      WHEN 'WRONG PARKING' THEN 1.5e0 WHEN 'PARKING ON FOOTPATH' THEN 1.2e0 ELSE 1.0e0 END"""

LANES_CASE = """CASE final_vehicle_type
      WHEN 'SCOOTER' THEN 0.3e0 WHEN 'MOTOR CYCLE' THEN 0.3e0 WHEN 'MOPED' THEN 0.3e0
      WHEN 'CAR' THEN 1.0e0 WHEN 'JEEP' THEN 1.0e0
      WHEN 'PASSENGER AUTO' THEN 0.8e0 WHEN 'GOODS AUTO' THEN 0.8e0
      WHEN 'VAN' THEN 1.5e0 WHEN 'TEMPO' THEN 1.5e0 WHEN 'LGV' THEN 1.5e0 WHEN 'MAXI-CAB' THEN 1.8e0
      WHEN 'PRIVATE BUS' THEN 2.5e0 WHEN 'BUS (BMTC/KSRTC)' THEN 2.5e0
      WHEN 'LORRY/GOODS VEHICLE' THEN 2.5e0 WHEN 'HGV' THEN 2.5e0 WHEN 'TANKER' THEN 3.0e0
      ELSE 1.0e0 END"""


def features_cte(device_t: int = DEVICE_T) -> str:
    return RAW + f""",
weighted AS (
  SELECT *,
    coalesce(updated_vehicle_type, vehicle_type) AS final_vehicle_type,
    CASE validation_status WHEN 'approved' THEN 1.5e0 WHEN 'rejected' THEN 0e0
      WHEN 'processing' THEN 0.8e0 WHEN 'duplicate' THEN 0.3e0 ELSE 1.0e0 END AS validation_weight,
    CASE WHEN data_sent_to_scita THEN 1.2e0 WHEN NOT data_sent_to_scita THEN 0.9e0 END AS scita_weight,
    coalesce(regexp_extract_all(violation_type, '"([^"]+)"', 1), CAST([] AS VARCHAR[])) AS labels
  FROM violations_raw
  WHERE latitude BETWEEN 12.75e0 AND 13.15e0 AND longitude BETWEEN 77.35e0 AND 77.85e0
),
scored_rows AS (
  SELECT *,
    coalesce(list_max(list_transform(labels, lambda x: {SEVERITY_CASE})), 1.0e0) AS vtype_severity,
    1.0e0 + (len(labels) - 1) * 0.3e0 AS compound_score,
    {LANES_CASE} AS lanes_blocked
  FROM weighted WHERE validation_weight > 0
),
fixed_devices AS (
  SELECT device_id FROM scored_rows WHERE device_id IS NOT NULL
  GROUP BY device_id HAVING count(*) >= {device_t}
),
features AS (
  SELECT s.*,
    CASE WHEN d.device_id IS NOT NULL THEN 'fixed_camera' ELSE 'patrol' END AS device_type,
    vtype_severity * lanes_blocked * compound_score * validation_weight * scita_weight AS impact,
    CAST(hour(created_datetime) AS INTEGER) AS hour,
    dayname(created_datetime) AS dow,
    CAST(month(created_datetime) AS INTEGER) AS month,
    CAST(created_datetime AS DATE) AS date,
    CAST(weekofyear(created_datetime) AS INTEGER) AS week,
    (hour(created_datetime) < 6 OR hour(created_datetime) >= 19) AS is_peak,
    isodow(created_datetime) >= 6 AS is_weekend,
    true_zone AS cluster
  FROM scored_rows s LEFT JOIN fixed_devices d ON s.device_id = d.device_id
)"""


def r6(col: str, alias: str | None = None) -> str:
    return f"round_even(CAST({col} AS DOUBLE) * 1e6, 0) / 1e6 AS {alias or col}"


def r1(expr: str) -> str:
    return f"round_even(({expr}) * 10e0, 0) / 10e0"


def mode_cte(name: str, source: str, keys: str, value: str, where: str = "TRUE") -> str:
    """Most frequent non-null value per key; ties to the smallest value."""
    return f"""{name} AS (
  SELECT {keys}, v AS {name}_value FROM (
    SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, v ASC) AS rn
    FROM (SELECT {keys}, {value} AS v, count(*) AS n FROM {source}
          WHERE ({where}) AND {value} IS NOT NULL GROUP BY {keys}, {value})
  ) WHERE rn = 1
)"""


def zone_stats_cte(source: str = "features") -> str:
    """17 statistics per zone plus junction label and zone name."""
    return ",\n".join([
        mode_cte("m_junction", source, "cluster", "junction_name", "trim(junction_name) <> 'No Junction' AND cluster <> -1"),
        mode_cte("m_station", source, "cluster", "police_station", "cluster <> -1"),
        mode_cte("m_vehicle", source, "cluster", "final_vehicle_type", "cluster <> -1"),
        f"""zstats AS (
  SELECT a.*,
    CASE WHEN j.m_junction_value IS NULL THEN NULL
         ELSE string_split(j.m_junction_value, ' - ')[-1] END AS junction_label,
    s.m_station_value AS police_station, v.m_vehicle_value AS top_vehicle
  FROM (
    SELECT cluster,
      count(id) AS violation_count,
      CAST(sum(CAST(latitude AS DECIMAL(30,12))) AS DOUBLE) / count(latitude) AS lat,
      CAST(sum(CAST(longitude AS DECIMAL(30,12))) AS DOUBLE) / count(longitude) AS lon,
      coalesce(CAST(sum(CAST(impact AS DECIMAL(28,6))) AS DOUBLE), 0e0) AS total_impact, avg(impact) AS avg_impact,
      CAST(sum(CAST(lanes_blocked AS DECIMAL(28,6))) AS DOUBLE) / count(lanes_blocked) AS avg_lanes_blocked,
      avg(CASE WHEN is_peak THEN 1e0 ELSE 0e0 END) AS peak_pct,
      avg(CASE WHEN is_weekend THEN 1e0 ELSE 0e0 END) AS weekend_pct,
      count(DISTINCT date) AS active_days, count(DISTINCT week) AS active_weeks,
      avg(CASE WHEN validation_weight = 1.5e0 THEN 1e0 ELSE 0e0 END) AS approved_pct,
      avg(CASE WHEN scita_weight = 1.2e0 THEN 1e0 ELSE 0e0 END) AS scita_pct,
      avg(CASE WHEN device_type = 'fixed_camera' THEN 1e0 ELSE 0e0 END) AS fixed_camera_pct,
      avg(CASE WHEN compound_score > 1.0e0 THEN 1e0 ELSE 0e0 END) AS compound_pct
    FROM {source} WHERE cluster <> -1 GROUP BY cluster
  ) a
  LEFT JOIN m_junction j USING (cluster)
  LEFT JOIN m_station s USING (cluster)
  LEFT JOIN m_vehicle v USING (cluster)
),
zones_named AS (
  SELECT *, coalesce(junction_label, police_station || ' area') AS zone_name FROM zstats
)""",
    ])


def mm(col: str, part: str = "") -> str:
    over = f"OVER ({part})"
    return (f"(({col}) - min({col}) {over}) / CASE WHEN max({col}) {over} - min({col}) {over} > 0 "
            f"THEN max({col}) {over} - min({col}) {over} ELSE 1e0 END")


def score_cte(name: str, source: str, weights: list[tuple[str, float]], part: str = "") -> str:
    """Components, raw score and congestion score over ``source`` (one row per zone [and tick])."""
    comps = {
        "c_impact": "total_impact", "c_lanes": "avg_lanes_blocked", "c_peak": "peak_pct",
        "c_consistency": "active_days", "c_persistence": "active_weeks",
        "c_official": "(approved_pct * 0.6e0 + scita_pct * 0.4e0)", "c_compound": "compound_pct",
    }
    comp_sql = ",\n    ".join(f"{mm(src, part)} AS {c}" for c, src in comps.items())
    wsum = " + ".join(f"{c} * {w!r}e0" if "e" not in repr(w) else f"{c} * {w!r}" for c, w in weights)
    return f"""{name}_c AS (
  SELECT *,
    {comp_sql}
  FROM {source}
),
{name}_r AS (SELECT *, {wsum} AS raw_score FROM {name}_c),
{name} AS (
  SELECT *,
    {r1(mm('raw_score', part) + ' * 100e0')} AS congestion_score,
    {r1('avg_lanes_blocked / 4e0 * 100e0')} AS blockage_pct,
    {r1('violation_count / active_days')} AS daily_rate
  FROM {name}_r
)"""


TIER = """CASE WHEN congestion_score >= 75 THEN 'CRITICAL' WHEN congestion_score >= 50 THEN 'HIGH'
      WHEN congestion_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"""

SHIFT_BATCH = """CASE WHEN peak_pct > 0.85e0 THEN 'Late night (11pm–4am)'
      WHEN peak_pct > 0.60e0 THEN 'Evening + night (7pm–midnight)' ELSE 'Mixed / daytime' END"""

SHIFT_LIVE = """CASE WHEN peak_pct > 0.75e0 THEN 'Late night / early morning (7pm–6am)'
      WHEN peak_pct > 0.40e0 THEN 'Evening + night (7pm–midnight)' ELSE 'Daytime (6am–7pm)' END"""

BATCH_W = [("c_impact", 0.30), ("c_lanes", 0.15), ("c_peak", 0.15), ("c_consistency", 0.15),
           ("c_persistence", 0.10), ("c_official", 0.10), ("c_compound", 0.05)]
LIVE_W = [("c_impact", 0.28), ("c_lanes", 0.28), ("c_peak", 0.18), ("c_consistency", 0.20),
          ("c_persistence", 0.05), ("c_official", 0.01), ("c_compound", 0.00)]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)
