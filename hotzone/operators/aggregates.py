"""Aggregations.

Every grouping here is a partial + final aggregation over fixed-size values
(sums, counts, extremes, bit sets in longs), so a zone that holds a third of all
rows is combined map-side before the shuffle and no task builds a set or a map.
Distinct dates and weeks are bits: rows are grouped by zone and nine-week block
first, a block's 63 days and nine weeks are one bit each, and the blocks' bits
are counted. The most frequent value comes from counts by zone and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions import scalar as S
from hotzone.operators.util import with_one_row


EXACT = "decimal(28,6)"
EXACT_COORD = "decimal(30,12)"  # coordinates: 12 places is far below a millimetre


def exact_sum(col, dtype: str = EXACT) -> Column:
    """Sum in fixed point: exact and associative, so the result does not depend
    on partitioning or on pre-aggregation (returned as a decimal)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(dtype))


def exact_avg(col, dtype: str = EXACT) -> Column:
    """Mean of non-null values from an exact sum; the same double on any layout."""
    c = F.col(col) if isinstance(col, str) else col
    return exact_sum(c, dtype).cast("double") / F.count(c)


def modes(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Most frequent non-null value of each expression per group (D4); ties go to
    the smallest value. One row per group with any value, one column per name.

    Rows are counted by (group, name, value), combined map-side; the best of a
    group is the least (-count, value) of those counts.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), c.cast("string").alias("v")) for n, c in values.items()])).alias("_p")
    counted = (rows.select(*by, pairs).select(*by, F.col("_p.k").alias("_k"), F.col("_p.v").alias("_v")).filter("_v IS NOT NULL")
               .groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_n")))
    best = counted.groupBy(*by, "_k").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_b"))
    return best.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == n, F.col("_b.v"))).alias(n) for n in values])


#: Days from 1970-01-01 (a Thursday), counted so that weeks begin on Mondays.
MONDAYS = "(unix_date(date) + 3)"
BLOCK = f"CAST(floor({MONDAYS} / 63) AS INT)"  # nine weeks


def _statistics(rows: DataFrame, by: list[str], parts: list[Column], weeks_by_year: bool) -> DataFrame:
    """Sums of ``parts`` (named sums and counts) per group, with ``active_days``
    and ``active_weeks`` (D5): ISO week numbers, of any year together unless
    ``weeks_by_year`` (the original merges them: Q15)."""
    week = f"pmod(CAST(floor({MONDAYS} / 7) AS INT), 9)" if weeks_by_year else "CAST(week AS INT)"
    first = rows.groupBy(*by, F.expr(f"{BLOCK} AS _block")).agg(
        *parts, F.expr(f"bit_or(shiftleft(1L, pmod({MONDAYS}, 63))) AS _days"), F.expr(f"bit_or(shiftleft(1L, {week})) AS _weeks"))
    names = [c for c in first.columns if c not in (*by, "_block", "_days", "_weeks")]
    weeks = "sum(bit_count(_weeks))" if weeks_by_year else "bit_count(bit_or(_weeks))"
    return first.groupBy(*by).agg(
        *[F.expr(f"sum({n}) AS {n}") for n in names], F.expr("CAST(coalesce(sum(bit_count(_days)), 0) AS BIGINT) AS active_days"),
        F.expr(f"CAST(coalesce({weeks}, 0) AS BIGINT) AS active_weeks"))


def _ratio(part: str, whole: str, name: str) -> Column:
    """A mean from its parts; null without any."""
    return F.expr(f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE)) AS {name}")


def common_parts() -> list[Column]:
    """Counts and exact sums that add up over any split of the rows."""
    return [F.expr(e) for e in (
        "count(1) AS n_rows", "count(impact) AS n_impact", f"sum(CAST(impact AS {EXACT})) AS s_impact",
        "count(lanes_blocked) AS n_lanes", f"sum(CAST(lanes_blocked AS {EXACT})) AS s_lanes",
        "count(is_peak) AS n_peak", "count_if(is_peak) AS s_peak", "count_if(validation_weight = 1.5D) AS s_approved",
        "count_if(scita_weight = 1.2D) AS s_flag", "count_if(compound_score > 1.0D) AS s_compound")]


def common_stats() -> list[Column]:
    """The statistics that follow from :func:`common_parts`."""
    return [
        F.expr("coalesce(CAST(s_impact AS DOUBLE), 0D) AS total_impact"),
        _ratio("s_lanes", "n_lanes", "avg_lanes_blocked"), _ratio("s_peak", "n_peak", "peak_pct"),
        F.col("active_days"), F.col("active_weeks"), _ratio("s_approved", "n_rows", "approved_pct"),
        _ratio("s_flag", "n_rows", "scita_pct"), _ratio("s_compound", "n_rows", "compound_pct"),
    ]


def iso_week_key(date_col="date", by_year: bool = False) -> Column:
    """ISO week number; with ``by_year`` the ISO year is kept too, so equal week
    numbers of two years stay apart (the original merges them: Q15)."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    if not by_year:
        return F.weekofyear(d)
    iso_year = F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3))  # the week's Thursday
    return iso_year * 100 + F.weekofyear(d)


def zone_stats(features: DataFrame, key: str = "cluster", weeks_by_year: bool = False) -> DataFrame:
    """17 statistics per zone over clustered feature rows (D1), plus the zone name."""
    f = features.filter(F.col(key) != -1)
    sums = _statistics(f, [key], [
        *common_parts(), *map(F.expr, (
            "count(id) AS n_id", "count(latitude) AS n_lat", f"sum(CAST(latitude AS {EXACT_COORD})) AS s_lat",
            "count(longitude) AS n_lon", f"sum(CAST(longitude AS {EXACT_COORD})) AS s_lon", "sum(impact) AS s_impact_d",
            "count(is_weekend) AS n_weekend", "count_if(is_weekend) AS s_weekend", "count_if(device_type = 'fixed_camera') AS s_fixed")),
    ], weeks_by_year)
    agg = sums.select(
        key, F.col("n_id").alias("violation_count"), _ratio("s_lat", "n_lat", "lat"), _ratio("s_lon", "n_lon", "lon"),
        _ratio("s_impact_d", "n_impact", "avg_impact"), _ratio("s_weekend", "n_weekend", "weekend_pct"),
        _ratio("s_fixed", "n_rows", "fixed_camera_pct"), *common_stats())
    texts = modes(f, [key], {"_junction": S.named_junction(), "police_station": F.col("police_station"), "top_vehicle": F.col("final_vehicle_type")})
    return (agg.join(texts, key, "left").withColumn("junction_label", S.short_junction("_junction")).drop("_junction")
            .withColumn("zone_name", S.zone_name()))


def window_stats(rows: DataFrame, by: list[str], weeks_by_year: bool = False) -> DataFrame:
    """10 statistics per zone in a scoring window (D2); ``violation_count``
    counts rows with a non-null impact (as the live scorer does)."""
    sums = _statistics(rows, by, common_parts(), weeks_by_year)
    agg = sums.select(*by, F.col("n_impact").alias("violation_count"), *common_stats())
    return agg.join(modes(rows, by, {"police_station": F.col("police_station")}), by, "left")


def hourly_counts(features: DataFrame) -> DataFrame:
    """Rows per (cluster, date, hour, dow, month, weekend, peak): count of
    non-null impact and mean impact (D6). Groups with only null impact stay, with 0."""
    f = features.filter(F.col("cluster") != -1).select(
        "cluster", "date", "hour", "month", "impact",
        S.weekday_num("date").alias("dow_num"),
        (S.weekday_num("date") >= 5).cast("int").alias("is_weekend"),
        S.is_peak("hour").cast("int").alias("is_peak"),
    )
    return f.groupBy("cluster", "date", "hour", "dow_num", "month", "is_weekend", "is_peak").agg(
        F.count("impact").alias("violation_count"),
        F.avg("impact").alias("avg_impact"),
    )


def hist_means(hourly: DataFrame, before=None) -> tuple[DataFrame, DataFrame]:
    """Mean hourly count by (cluster, hour, dow) and by (cluster, hour).

    By default every date is used, the target row included (as the original
    does: Q18); ``before`` (a date) keeps only earlier dates."""
    if before is not None:
        hourly = hourly.filter(F.col("date") < F.lit(before).cast("date"))
    by_dow = hourly.groupBy("cluster", "hour", "dow_num").agg(
        F.avg("violation_count").alias("hist_mean_violations"))
    by_hour = hourly.groupBy("cluster", "hour").agg(F.avg("violation_count").alias("hist_mean_ch"))
    return by_dow, by_hour


def cluster_profile(features: DataFrame) -> DataFrame:
    """Mean impact, mean lanes and log1p(rows) per cluster."""
    return features.filter(F.col("cluster") != -1).groupBy("cluster").agg(
        F.avg("impact").alias("cluster_avg_impact"),
        F.avg("lanes_blocked").alias("cluster_avg_lanes"),
        F.log1p(F.count(F.lit(1)).cast("double")).alias("cluster_total_log"),
    )


def rate_baseline(features: DataFrame, fill_empty_days: bool = False) -> DataFrame:
    """Rows per (cluster, date), then mean, sample std and days per cluster;
    std of a single day becomes 1.0 (D9, I1).

    By default only days with at least one row count (as the original: Q16).
    ``fill_empty_days`` counts every day of the data's date span, empty days as
    0, from sums alone (no zero rows are made): mean = S/D and sample variance
    = (Q - S^2/D)/(D - 1) over the span's D days.
    """
    clustered = features.filter(F.col("cluster") != -1)
    daily = clustered.groupBy("cluster", "date").agg(F.count(F.lit(1)).alias("daily_count"))
    if fill_empty_days:
        from hotzone.operators.util import with_one_row

        span = features.agg((F.datediff(F.max("date"), F.min("date")) + 1).cast("double").alias("_D"))
        sums = daily.groupBy("cluster").agg(F.sum("daily_count").cast("double").alias("_S"),
                                            F.sum(F.col("daily_count") * F.col("daily_count")).cast("double").alias("_Q"))
        t = with_one_row(sums, span)
        var = (F.col("_Q") - F.col("_S") * F.col("_S") / F.col("_D")) / (F.col("_D") - 1.0)
        return t.select(
            "cluster",
            (F.col("_S") / F.col("_D")).alias("baseline_mean"),
            F.when(F.col("_D") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(P.STD_SINGLE_DAY)).alias("baseline_std"),
            F.col("_D").cast("long").alias("baseline_n"),
        )
    return daily.groupBy("cluster").agg(
        F.avg("daily_count").alias("baseline_mean"),
        F.coalesce(F.stddev_samp("daily_count"), F.lit(P.STD_SINGLE_DAY)).alias("baseline_std"),
        F.count(F.lit(1)).alias("baseline_n"),
    )


def mae(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute error, global or per group."""
    err = F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae")
    return df.groupBy(*by).agg(err) if by else df.agg(err)


def active_clusters(log: DataFrame) -> DataFrame:
    """Distinct clusters of the log, noise excluded."""
    return log.filter(F.col("cluster") != -1).select("cluster").distinct()


def score_pivot(scores: DataFrame, n: int = 5, ts: str = "recalculated_at") -> DataFrame:
    """Trend table (D14): a row per tick, a column ``zone_1`` .. ``zone_n`` with the
    mean score of each of the top ``n`` zones of the newest tick (highest score
    first, ties by cluster), and ``name_1`` .. with the zones' names. Columns are
    places, so neither zone names nor their number reach the plan."""
    from hotzone.operators.ranking import latest_global, top_n
    from hotzone.operators.util import with_one_row

    top = top_n(latest_global(scores, ts), ["-congestion_score", "cluster"], n).select("cluster", "zone_name", "congestion_score")
    order = F.sort_array(F.collect_list(F.struct((-F.col("congestion_score")).alias("k"), "cluster", "zone_name")))
    j = with_one_row(scores.select(ts, "cluster", "congestion_score"), top.agg(order.alias("_top")))
    return j.groupBy(ts).agg(*[
        e for i in range(n) for e in (
            F.avg(F.when(F.col("cluster") == F.get("_top", F.lit(i))["cluster"], F.col("congestion_score"))).alias(f"zone_{i + 1}"),
            F.first(F.get("_top", F.lit(i))["zone_name"]).alias(f"name_{i + 1}"))])


def prep_kpis(raw: DataFrame, features: DataFrame, zones: DataFrame, top_n: int = 10) -> DataFrame:
    """Preprocess summary in one row (D13): totals, removed rows, clusters, tiers,
    assigned share, peak share, mean blockage of the top zones, corrected-type
    share, fixed-camera share, flagged share."""
    boxed = features  # features are already box-filtered and without rejected rows
    raw_box = raw.select("id", "latitude", "longitude", "validation_status", "updated_vehicle_type")
    from hotzone.operators.features import geo_filter  # local import: avoid a cycle
    rb = geo_filter(raw_box).agg(
        F.count(F.lit(1)).alias("rows_in_box"),
        F.avg(F.col("updated_vehicle_type").isNotNull().cast("double")).alias("corrected_type_share"),
    )
    f = boxed.agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count_if(F.col("cluster") != -1).alias("rows_assigned"),
        F.avg(F.col("is_peak").cast("double")).alias("peak_share"),
        F.avg((F.col("device_type") == "fixed_camera").cast("double")).alias("fixed_camera_share"),
        F.count_if(F.col("data_sent_to_scita")).alias("flagged_rows"),
    )
    top = zones.orderBy(F.col("congestion_score").desc(), F.col("cluster")).limit(top_n)
    z = zones.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_zones"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_zones"),
    )
    t = top.agg(F.avg("blockage_pct").alias("top_blockage_pct"))
    return (with_one_row(with_one_row(with_one_row(rb, f), z), t)
            .withColumn("rows_removed", F.col("rows_in_box") - F.col("rows_kept"))
            .withColumn("assigned_share", F.col("rows_assigned") / F.col("rows_kept")))
