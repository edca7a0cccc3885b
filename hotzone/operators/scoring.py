"""Zone scoring: min-max components, weighted sum, tiers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions import scalar as S
from hotzone.operators.aggregates import common_parts, common_stats, window_stats, zone_stats
from hotzone.operators.util import with_one_row
from hotzone.session import saved

TICK = "recalculated_at"


def minmax(df: DataFrame, cols: dict[str, str], by: list[str] | None = None,
           groups_max: int | None = None) -> DataFrame:
    """Min-max normalise each source column into a new column within each ``by``
    group; a zero range gives 0 (E1).

    The extremes are an aggregate with one row per group (per scoring tick;
    one row without ``by``), partially combined on every task and joined back
    by broadcast. No task ever holds all zones. ``groups_max`` is a known
    bound on the group count (the caller's tick list, which lies on the
    driver anyway); without one the join is left to AQE.
    """
    by = by or []
    aggs = []
    for src in cols:
        aggs += [F.min(src).alias(f"_lo_{src}"), F.max(src).alias(f"_hi_{src}")]
    if by:
        ext = df.groupBy(*by).agg(*aggs)
        if groups_max is not None:
            ext = F.broadcast(ext)
        joined = df.join(ext, on=by, how="inner")
    else:
        joined = with_one_row(df, df.agg(*aggs))
    new = []
    for src, dst in cols.items():
        lo, hi = F.col(f"_lo_{src}"), F.col(f"_hi_{src}")
        rng = hi - lo
        new.append(((F.col(src) - lo) / F.when(rng > 0, rng).otherwise(F.lit(1.0))).alias(dst))
    keep = [c for c in df.columns if c not in cols.values()]
    return joined.select(*keep, *new)


def _components(stats: DataFrame, by: list[str], groups_max: int | None) -> DataFrame:
    stats = stats.select("*", (F.col("approved_pct") * P.OFFICIAL_APPROVED_SHARE
                               + F.col("scita_pct") * P.OFFICIAL_FLAG_SHARE).alias("_official"))
    out = minmax(stats, {
        "total_impact": "c_impact",
        "avg_lanes_blocked": "c_lanes",
        "peak_pct": "c_peak",
        "active_days": "c_consistency",
        "active_weeks": "c_persistence",
        "_official": "c_official",
        "compound_pct": "c_compound",
    }, by, groups_max)
    return out.drop("_official")


def _weighted(weights) -> "F.Column":
    expr = None
    for name, w in weights:
        term = F.col(name) * F.lit(w)
        expr = term if expr is None else expr + term
    return expr


def score_stats(stats: DataFrame, weights, by: list[str] | None = None, groups_max: int | None = None) -> DataFrame:
    """Components, raw score and the 0..100 congestion score (rounded half even
    to one place), tier, blockage and daily rate."""
    by = by or []
    # one row per zone (and tick), read several times below: written once, so the events are read once
    df = _components(saved(stats, "stats"), by, groups_max)
    df = df.select("*", _weighted(weights).alias("raw_score"))
    df = minmax(df, {"raw_score": "_raw_mm"}, by, groups_max)
    score = S.r1(F.col("_raw_mm") * 100.0)
    return df.select(
        *[c for c in df.columns if c != "_raw_mm"],
        score.alias("congestion_score"),
        S.risk_tier(score).alias("risk_tier"),
        S.r1(F.col("avg_lanes_blocked") / P.LANES_FULL_ROAD * 100.0).alias("blockage_pct"),
        S.r1(F.col("violation_count") / F.col("active_days")).alias("daily_rate"),
    )


def score_batch(features: DataFrame, weights=None) -> DataFrame:
    """Batch zone table (G1): 17 statistics, 7 components, score, tier, shift,
    weekend bias."""
    stats = zone_stats(features)
    out = score_stats(stats, weights or P.BATCH_WEIGHTS)
    return (out.withColumn("enforcement_shift", S.shift_label("peak_pct", "batch"))
            .withColumn("weekend_bias", S.weekend_bias("weekend_pct")))


def top_zones(zones: DataFrame, n: int = 20) -> DataFrame:
    """The n best zones with rank 1..n and the peak share in percent.
    TakeOrderedAndProject keeps n rows per task; the rank is over those n only."""
    top = zones.orderBy(F.col("congestion_score").desc(), F.col("cluster")).limit(n)
    w = Window.orderBy(F.col("congestion_score").desc(), F.col("cluster"))
    return (top.withColumn("rank", F.row_number().over(w))
            .withColumn("peak_pct_pct", S.r1(F.col("peak_pct") * 100.0)))


LIVE_COLUMNS = [
    "cluster", TICK, "violation_count", "total_impact", "avg_lanes_blocked", "peak_pct",
    "active_days", "active_weeks", "approved_pct", "scita_pct", "compound_pct",
    "congestion_score", "risk_tier", "zone_name", "police_station", "daily_rate",
    "blockage_pct", "enforcement_shift",
]


def _finish_live(scored: DataFrame, meta: DataFrame | None) -> DataFrame:
    scored = scored.withColumn("enforcement_shift", S.shift_label("peak_pct", "live"))
    if meta is not None:
        m = meta.select("cluster", F.col("zone_name").alias("_meta_name"))  # one row per cluster (zone_meta)
        # one row per cluster; AQE turns this into a broadcast at runtime when it is small
        scored = scored.join(m, on="cluster", how="left")
    else:
        scored = scored.withColumn("_meta_name", F.lit(None).cast("string"))
    scored = scored.withColumn("zone_name", F.coalesce("_meta_name", F.concat(F.col("police_station"), F.lit(" area"))))
    return scored.select(*LIVE_COLUMNS)


def score_live(log: DataFrame, as_of, window: str = "30 days", meta: DataFrame | None = None,
               ts: str = "created_datetime", weights=None) -> DataFrame:
    """Score zones over the window ``[as_of - window, as_of)`` of the log.

    ``as_of`` is a parameter, never the clock; ``ts`` is the time column the
    window applies to.
    """
    as_of_c = S.ts_lit(as_of)
    start = as_of_c - F.expr(f"INTERVAL {window}")
    rows = log.filter((F.col("cluster") != -1) & (F.col(ts) >= start) & (F.col(ts) < as_of_c))
    if "date" in log.columns and ts == "created_datetime":
        # lets a log partitioned by date skip whole days outside the window
        rows = rows.filter(F.col("date").between(F.to_date(start), F.to_date(as_of_c)))
    stats = window_stats(rows, ["cluster"]).withColumn(TICK, as_of_c)
    scored = score_stats(stats, weights or P.LIVE_WEIGHTS, [TICK], 1)
    return _finish_live(scored, meta)


def _bucket_unit(ticks: list) -> str | None:
    """The coarsest time unit that every tick is a whole multiple of (None: finer than a second)."""
    if not all(isinstance(t, dt.datetime) for t in ticks) or any(t.microsecond for t in ticks):
        return None
    for unit, whole in (("day", lambda t: t.time() == dt.time(0)), ("hour", lambda t: t.minute == t.second == 0),
                        ("minute", lambda t: t.second == 0)):
        if all(whole(t) for t in ticks):
            return unit
    return "second"


#: What a time bucket adds to the windows it lies in.
SUMS = {"n_impact": "long", "s_impact": "decimal(38,6)", "n_rows": "long", "n_lanes": "long", "s_lanes": "decimal(38,6)", "n_peak": "long",
        "s_peak": "long", "s_approved": "long", "s_flag": "long", "s_compound": "long"}


def _rank(at: str) -> "F.Column":
    """How many of the sorted ``_ticks`` (microseconds) are at or before ``at``: a binary search."""
    return F.expr(f"""aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size(_ticks)), (s, i) ->
        if(s.lo >= s.hi, s, if(element_at(_ticks, CAST(floor((s.lo + s.hi) / 2) AS INT) + 1) <= {at},
           named_struct('lo', CAST(floor((s.lo + s.hi) / 2) AS INT) + 1, 'hi', s.hi),
           named_struct('lo', s.lo, 'hi', CAST(floor((s.lo + s.hi) / 2) AS INT)))), s -> s.lo)""")


def _running(ranges: DataFrame, by: list[str], sums: dict[str, str], n_ticks: int) -> DataFrame:
    """``by, tick`` and the sums over all rows whose tick range ``[first, past)``
    holds the tick, for ticks with any row.

    A row adds its values at the first tick of its range and takes them away at
    the tick past it; a running total in tick order gives every window, and
    stays as it is between two changes. So the cost is the rows plus the ticks
    per group, however many windows a row lies in.
    """
    moves = (ranges.filter("first < past")
             .selectExpr(*by, *sums, "explode(array(struct(first AS tick, true AS enters), struct(past AS tick, false AS enters))) AS _t")
             .filter(f"_t.tick < {n_ticks}"))
    changes = moves.groupBy(*by, F.expr("_t.tick AS tick")).agg(*[F.expr(f"CAST(sum(if(_t.enters, {c}, -{c})) AS {t}) AS {c}") for c, t in sums.items()])
    w = f"OVER (PARTITION BY {', '.join(by)} ORDER BY tick)"
    total = changes.selectExpr(*by, "tick", *[f"CAST(sum({c}) {w} AS {t}) AS {c}" for c, t in sums.items()], f"lead(tick, 1, {n_ticks}) {w} AS _next")
    return total.filter("n_rows > 0").withColumn("tick", F.expr("explode(sequence(tick, _next - 1))")).drop("_next")


def tick_buckets(rows: DataFrame, unit: str | None, ts: str = "created_datetime") -> DataFrame:
    """One row per (cluster, time bucket ``_d``, station), noise excluded, with the parts that add up over any split of the rows."""
    if unit is None:
        raise ValueError("ticks must be datetimes on whole seconds")
    return (rows.filter(F.col("cluster") != -1).withColumn("_d", F.date_trunc(unit, F.col(ts)))
            .groupBy("cluster", "_d", "police_station").agg(*common_parts()))


def merged_buckets(buckets: DataFrame) -> DataFrame:
    """The buckets of several splits of the rows, added up."""
    return buckets.groupBy("cluster", "_d", "police_station").agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS.items()])


def score_ticks(spark: SparkSession, log: DataFrame, ticks: list, window_days: int = 30,
                meta: DataFrame | None = None, ts: str = "created_datetime", weights=None, bucketed: bool = False) -> DataFrame:
    """Live scores for many ticks in one job.

    The log is first reduced, map-side combined, to one row per (cluster,
    station, time bucket), a bucket being the coarsest unit that the ticks and
    the window are whole multiples of (days for midnights, hours for ticks on
    the hour, and so on). A bucket lies in the windows of a range of ticks;
    running totals over the ranges' ends give the sums of every window (see
    :func:`_running`), so nothing is copied once per tick. Active days and weeks
    are ranges too: a day from its first to its last bucket, a week the union
    of its days' ranges. Ticks must be datetimes on whole seconds; windows whole days.
    ``bucketed``: the log is its buckets already (and there is a tick at least).
    """
    if bucketed:
        return score_buckets(spark, log, ticks, window_days, meta, weights)
    ticks = sorted(set(ticks))
    unit = _bucket_unit(ticks)
    if unit is None:
        raise ValueError("ticks must be datetimes on whole seconds")
    rows = log.filter(F.col("cluster") != -1)
    if not ticks:
        stats = window_stats(rows.withColumn(TICK, F.lit(None).cast("timestamp")).filter(F.lit(False)), [TICK, "cluster"])
        return _finish_live(score_stats(stats, weights or P.LIVE_WEIGHTS, [TICK], 0), meta)
    days = int(window_days)
    if "date" in log.columns and ts == "created_datetime":
        # partition pruning: only the dates inside some tick's window are read
        lo = min(ticks) - dt.timedelta(days=days)
        rows = rows.filter(F.col("date").between(F.lit(lo.date()), F.lit(max(ticks).date())))
    return score_buckets(spark, tick_buckets(rows, unit, ts), ticks, days, meta, weights)


def score_buckets(spark: SparkSession, buckets: DataFrame, ticks: list, window_days: int = 30,
                  meta: DataFrame | None = None, weights=None) -> DataFrame:
    """:func:`score_ticks` from the rows' buckets (see :func:`tick_buckets`), for one tick at least."""
    ticks, days = sorted(set(ticks)), int(window_days)
    buckets = buckets.filter("_d IS NOT NULL")
    when = spark.createDataFrame([(k, t.isoformat(sep=" ")) for k, t in enumerate(ticks)], "tick int, _t string").select("tick", F.col("_t").cast("timestamp").alias(TICK))
    one = when.agg(F.sort_array(F.collect_list(F.unix_micros(TICK))).alias("_ticks"))
    span = days * 86_400_000_000
    buckets = with_one_row(buckets, one).withColumns({"first": _rank("unix_micros(_d)"), "past": _rank(f"unix_micros(_d) + {span}L")}).drop("_ticks")
    buckets = saved(buckets.filter("first < past"), "buckets")
    n = len(ticks)
    # a day counts while one of its buckets is in the window: those are less than a window apart
    by_day = buckets.groupBy("cluster", F.expr("to_date(_d) AS day")).agg(F.expr("min(first) AS first"), F.expr("max(past) AS past"))
    seen = "max(past) OVER (PARTITION BY cluster, weekofyear(day) ORDER BY first, day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    by_week = by_day.selectExpr("cluster", f"greatest(first, coalesce({seen}, first)) AS first", "past")  # what no earlier day of the week covers
    none = [f"CAST(0 AS {t}) AS {c}" for c, t in SUMS.items()]
    ranges = (buckets.selectExpr("cluster", "first", "past", *SUMS, "0L AS active_days", "0L AS active_weeks")
              .unionByName(by_day.selectExpr("cluster", "first", "past", *none, "1L AS active_days", "0L AS active_weeks"))
              .unionByName(by_week.selectExpr("cluster", "first", "past", *none, "0L AS active_days", "1L AS active_weeks")))
    sums = _running(ranges, ["cluster"], {**SUMS, "active_days": "long", "active_weeks": "long"}, n)
    stations = _running(buckets.filter("police_station IS NOT NULL").select("cluster", "police_station", "first", "past", "n_rows"),
                        ["cluster", "police_station"], {"n_rows": "long"}, n)
    best = (stations.groupBy("cluster", "tick")  # mode ignores nulls; ties: smallest name
            .agg(F.min(F.struct((-F.col("n_rows")).alias("k"), F.col("police_station").alias("s"))).alias("_m"))
            .select("cluster", "tick", F.col("_m.s").alias("police_station")))
    stats = (sums.join(best, ["cluster", "tick"], "left").join(F.broadcast(when), "tick")
             .select(TICK, "cluster", F.col("n_impact").alias("violation_count"), *common_stats(), "police_station"))
    return _finish_live(score_stats(stats, weights or P.LIVE_WEIGHTS, [TICK], n), meta)


def retain(scores: DataFrame, as_of, interval: str = P.SCORE_RETENTION, ts: str = TICK) -> DataFrame:
    """Keep score rows from the last ``interval`` before ``as_of``."""
    return scores.filter(F.col(ts) >= S.ts_lit(as_of) - F.expr(f"INTERVAL {interval}"))


def zone_meta(zones: DataFrame) -> DataFrame:
    """One metadata row per cluster: name, station, centroid (input of C7)."""
    return zones.select("cluster", "zone_name", "police_station", "lat", "lon").dropDuplicates(["cluster"])


def with_zone_meta(df: DataFrame, meta: DataFrame, fill: dict | None = None) -> DataFrame:
    """Left join of zone metadata, one row per cluster, broadcast when small."""
    m = meta.dropDuplicates(["cluster"])
    overlap = [c for c in m.columns if c != "cluster" and c in df.columns]
    out = df.drop(*overlap).join(m, on="cluster", how="left")  # AQE broadcasts a small side
    return out.fillna(fill) if fill else out

