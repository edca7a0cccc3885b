"""Event sources: typed scans of raw violation records, and the mapping of the
test data's ``events`` table onto that schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hotzone.schemas import RAW_EVENTS


def read_events(spark: SparkSession, path: str, schema: StructType = RAW_EVENTS, fmt: str = "parquet",
                columns: Iterable[str] | None = None) -> DataFrame:
    """Typed scan of raw records (A1). CSV: header, explicit schema, PERMISSIVE.

    ``columns`` prunes the scan (A2); Catalyst pushes the projection into the
    Parquet/CSV reader so unread columns are never decoded.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    else:
        df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add a column with a default only when it is absent, never when it is null (A3)."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def normalise_time(df: DataFrame, col: str = "created_datetime") -> DataFrame:
    """Parse a time to a UTC timestamp; unparsable values become null and are dropped (A4).

    Text goes through ``try_to_timestamp`` (ANSI mode makes a plain cast raise);
    timestamps without zone are read in the session zone (UTC).
    """
    dtype = dict(df.dtypes)[col]
    if dtype == "string":
        parsed = F.try_to_timestamp(F.col(col))
    else:
        parsed = F.col(col).cast("timestamp")
    return df.withColumn(col, parsed).filter(F.col(col).isNotNull())


# ---------------------------------------------------------------------------
# Test data mapping: ``events`` -> raw violation records.
# ---------------------------------------------------------------------------

def _k() -> Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def violations_raw_from_events(events: DataFrame) -> DataFrame:
    """Map the generic ``events`` table onto raw violation records.

    Deterministic per row (no shuffle, map-only). ``true_zone`` is the zone
    the generator placed a row in (``user_id % 20`` for ``k < 96``, else -1),
    kept so tests can state the expected clustering.
    """
    # exploded, so that a filter on the columns below does not parse the text again for each of its terms
    events = events.select("*", F.explode(F.array(_k())).alias("_k"))
    k = F.col("_k")
    uid = F.col("user_id")
    eid = F.col("event_id")
    noise = k >= 96
    z = (uid % 20).cast("string")
    lat = (F.lit(12.77) + F.lit(0.09) * (uid % 4) + F.lit(0.0001) * (k % 10)
           + F.when(noise, F.lit(0.02) + F.lit(0.002) * (eid % 20)).otherwise(F.lit(0.0)))
    lon = (F.lit(77.40) + F.lit(0.10) * (uid % 5) + F.lit(0.0001) * F.floor(k / F.lit(10.0))
           + F.when(noise, F.lit(0.004) * (eid % 23)).otherwise(F.lit(0.0)))
    vehicle = (F.when(k % 6 == 0, "SCOOTER").when(k % 6 == 1, "CAR").when(k % 6 == 2, "PASSENGER AUTO")
               .when(k % 6 == 3, "MAXI-CAB").when(k % 6 == 4, "TANKER").otherwise("CYCLE RICKSHAW"))
    vtype = (F.when(k % 8 == 0, '["NO PARKING"]')
             .when(k % 8 == 1, '["WRONG PARKING","NO PARKING"]')
             .when(k % 8 == 2, '["PARKING IN A MAIN ROAD","DOUBLE PARKING","WRONG PARKING"]')
             .when(k % 8 == 3, '["PARKING ON FOOTPATH"]')
             .when(k % 8 == 4, '["DEFECTIVE NUMBER PLATE"]')
             .when(k % 8 == 6, "[]")
             .when(k % 8 == 7, '["DOUBLE PARKING","H T V PROHIBITED"]'))
    status = (F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "error", "rejected")
              .when(F.col("event_type") == "signup", "processing").when(F.col("event_type") == "view", "duplicate"))
    junction = (F.when(uid % 4 == 0, F.when(k % 2 == 0, "No Junction").otherwise("No Junction "))
                .when(uid % 4 == 1, F.concat(F.lit("BTP0"), z, F.lit(" - Zone "), z, F.lit(" Junction")))
                .when(uid % 4 == 3, F.when(k % 3 == 0, F.concat(F.lit("Circle "), z)).otherwise("No Junction")))
    station = F.when(uid % 20 == 19, "Unknown").otherwise(F.concat(F.lit("PS"), (uid % 6).cast("string")))
    return events.select(
        eid.alias("id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.col("ts").cast("timestamp").alias("created_datetime"),
        vehicle.alias("vehicle_type"),
        F.when(k % 13 == 0, "HGV").alias("updated_vehicle_type"),
        vtype.alias("violation_type"),
        status.alias("validation_status"),
        F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k % 2 == 0).alias("data_sent_to_scita"),
        uid.cast("string").alias("device_id"),
        junction.alias("junction_name"),
        station.alias("police_station"),
        F.when(~noise, (uid % 20).cast("int")).otherwise(F.lit(-1)).alias("true_zone"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def violations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw violation records derived from ``<sf_dir>/events.parquet``."""
    return violations_raw_from_events(read_table(spark, sf_dir, "events"))
