"""Operator hand cases: min-max, nearest centroid, anomalies, tier changes,
forecast band, top-n per group, skewed groups."""

import datetime as dt

from pyspark.sql import functions as F

from hotzone.operators import alerts as AL
from hotzone.operators import ranking as RK
from hotzone.operators import scoring as SC
from hotzone.operators import spatial as SP


def test_minmax_all_equal_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "cluster int, v double")
    got = [r.c for r in SC.minmax(df, {"v": "c"}).collect()]
    assert got == [0.0, 0.0]


def test_nearest_centroid_boundary(spark):
    m_per_deg = 6371000.0 * 3.141592653589793 / 180.0
    cents = spark.createDataFrame([(0, 12.9, 77.5)], "cluster int, lat double, lon double")
    pts = spark.createDataFrame([(1, 12.9 + 399.999 / m_per_deg, 77.5), (2, 12.9 + 400.1 / m_per_deg, 77.5)],
                                "id long, latitude double, longitude double")
    got = {r.id: (r.cluster, r.dist_centroid_m) for r in SP.assign_nearest(pts, cents, 400.0).collect()}
    assert got[1] == (0, 400.0)
    assert got[2] == (-1, 400.1)


def test_anomaly_floor_and_single_day(spark):
    scores = spark.createDataFrame([(1, 11.0, "Z", "S", dt.datetime(2024, 1, 2))],
                                   "cluster int, daily_rate double, zone_name string, police_station string, "
                                   "recalculated_at timestamp")
    base = spark.createDataFrame([(1, 10.0, 0.0, 5)], "cluster int, baseline_mean double, baseline_std double, baseline_n long")
    r = AL.rate_anomalies(scores, base).first()
    assert (r.z_score, r.anomaly_type, r.severity) == (2.0, "spike", "moderate")


def test_tier_change_from_absent_zone(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 10.0, "LOW", "A", "S", 1.0),
            (1, dt.datetime(2024, 1, 2), 10.0, "LOW", "A", "S", 1.0),
            (2, dt.datetime(2024, 1, 2), 60.0, "HIGH", "B", "S", 1.0)]
    sc = spark.createDataFrame(rows, "cluster int, recalculated_at timestamp, congestion_score double, "
                                     "risk_tier string, zone_name string, police_station string, daily_rate double")
    a = AL.tier_alerts(sc).collect()
    assert [(x.cluster, x.previous_tier, x.new_tier) for x in a] == [(2, "LOW", "HIGH")]


def test_top_n_per_group_skewed(spark):
    # one group holds most rows; the salted two-phase ranking must equal a plain ranking
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
                                     (F.col("id") * 7919 % 1000).cast("double").alias("v"), F.col("id"))
    got = {(r.g, r.id) for r in RK.top_n_per_group(df, ["g"], ["-v", "id"], 3, salt_buckets=16, salt_col="id").collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    exp = {(r.g, r.id) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").collect()}
    assert got == exp


def test_forecast_band_edges(spark):
    from hotzone.functions.scalar import forecast_band
    df = spark.createDataFrame([(20.0,), (19.9,), (10.0,), (9.9,)], "predicted_violations double")
    assert [r[0] for r in df.select(forecast_band()).collect()] == ["red", "orange", "orange", "green"]


def test_connected_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "src long, dst long")
    got = {r.node: r.comp for r in SP.connected_components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def test_iso_week_by_year(spark):
    from hotzone.operators.aggregates import iso_week_key
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2022, 1, 2),), (dt.date(2024, 12, 30),)], "date date")
    plain = [r[0] for r in df.select(iso_week_key("date")).collect()]
    keyed = [r[0] for r in df.select(iso_week_key("date", True)).collect()]
    assert plain == [53, 52, 1]
    assert keyed == [202053, 202152, 202501]


def test_baseline_fill_empty_days(spark):
    import statistics
    from hotzone.operators.aggregates import rate_baseline
    rows = [(1, dt.date(2024, 1, 1))] * 3 + [(1, dt.date(2024, 1, 3))] + [(2, dt.date(2024, 1, 4))] * 2
    f = spark.createDataFrame(rows, "cluster int, date date")
    got = {r.cluster: r for r in rate_baseline(f, fill_empty_days=True).collect()}
    c1 = [3, 0, 1, 0]
    assert abs(got[1].baseline_mean - statistics.mean(c1)) < 1e-12
    assert abs(got[1].baseline_std - statistics.stdev(c1)) < 1e-12
    assert got[2].baseline_n == 4
    plain = {r.cluster: r for r in rate_baseline(f).collect()}
    assert plain[1].baseline_mean == 2.0 and plain[2].baseline_std == 1.0


def test_hist_means_before(spark):
    from hotzone.operators.aggregates import hist_means
    h = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5, 0, 2), (1, dt.date(2024, 1, 8), 5, 0, 6)],
                              "cluster int, date date, hour int, dow_num int, violation_count long")
    all_, _ = hist_means(h)
    early, _ = hist_means(h, before=dt.date(2024, 1, 8))
    assert all_.first().hist_mean_violations == 4.0
    assert early.first().hist_mean_violations == 2.0


def test_ordinal_is_distributed_and_exact(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3001).alias("k"))
    got = {r.k: r.o for r in RK.ordinal(df, ["k"], "o", partitions=7).collect()}
    ks = sorted(got)
    assert [got[k] for k in ks] == list(range(1, len(ks) + 1))
