"""Numbering and nearest-centroid assignment at sizes where shortcuts break."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotzone.operators import spatial as SP
from hotzone.operators.ranking import ordinal

R = 6371000.0


@pytest.mark.parametrize("partitions", [3, 8, 40])
def test_ordinal_is_exact_with_payload(spark, partitions):
    n = 100_000
    df = (spark.range(n).withColumn("g", F.col("id") % 70_000).groupBy("g")
          .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"), F.max(F.md5(F.col("id").cast("string"))).alias("pay")))
    got = ordinal(df, ["first"], "n", partitions).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.max(F.abs(F.col("n") - 1 - F.col("first"))).alias("off")).first()
    assert tuple(got) == (70_000, 70_000, 1, 70_000, 0)


def test_many_clusters_keep_their_numbers(spark):
    # 2,500 street corners a kilometre apart, five rows each
    side = 50
    pts = [(5 * (a * side + b) + k, 12.0 + a * 0.01, 77.0 + b * 0.01) for a in range(side) for b in range(side) for k in range(5)]
    random.Random(3).shuffle(pts)
    df = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    got = SP.dbscan(df, 100.0, 3)
    per = got.groupBy("cluster").agg(F.countDistinct("latitude", "longitude").alias("places"), F.count(F.lit(1)).alias("rows"))
    assert tuple(per.agg(F.count(F.lit(1)), F.max("places"), F.max("rows"), F.min("cluster"), F.max("cluster")).first()) == (2500, 1, 5, 0, 2499)


def test_dbscan_rows_without_coordinates_are_noise(spark):
    df = spark.createDataFrame([(1, 12.0, 77.0), (2, 12.0, 77.0), (3, None, 77.0), (4, None, None)], "id long, latitude double, longitude double")
    got = {r.id: (r.cluster, r.is_core) for r in SP.dbscan(df, 100.0, 2).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False)}


def brute_nearest(pts, cents, max_m):
    la, lo = np.radians([c[1] for c in cents]), np.radians([c[2] for c in cents])
    out = []
    for _, a, o in pts:
        if a is None or o is None:
            out.append((-1, None))
            continue
        x = np.sin((la - math.radians(a)) / 2) ** 2 + np.cos(la) * math.cos(math.radians(a)) * np.sin((lo - math.radians(o)) / 2) ** 2
        d = 2 * R * np.arcsin(np.sqrt(x))
        out.append((cents[int(d.argmin())][0] if d.min() <= max_m else -1, d.min()))
    return out


@pytest.mark.parametrize("n_cents", [0, 1, 300, 60_000])
def test_assign_nearest_matches_brute_force(spark, n_cents):
    rnd = random.Random(n_cents)
    cents = [(i, 12.0 + rnd.random() * 1.5, 77.0 + rnd.random() * 1.5) for i in range(n_cents)]
    pts = [(i, 11.0 + rnd.random() * 3.5, 76.0 + rnd.random() * 3.5) for i in range(150)]
    pts += [(i + 150, 12.0 + rnd.random() * 1.5, 77.0 + rnd.random() * 1.5) for i in range(150)]
    pts += [(300, 55.0, 10.0), (301, -40.0, 170.0), (302, None, 77.0), (303, None, None)]
    pts += [pts[0], pts[0], pts[200]]  # equal rows stay
    df = spark.createDataFrame([(*p, None) for p in pts], "id long, latitude double, longitude double, impact double")
    cdf = spark.createDataFrame(cents, "cluster int, lat double, lon double")
    got = sorted(((r.id, r.cluster, r.dist_centroid_m) for r in SP.assign_nearest(df, cdf, 400.0).collect()), key=lambda r: r[0])
    want = sorted(zip([p[0] for p in pts], brute_nearest(pts, cents, 400.0) if cents else [(-1, None)] * len(pts)), key=lambda r: r[0])
    assert len(got) == len(want)
    for (i, c, d), (j, (wc, wd)) in zip(got, want):
        assert i == j and c == wc
        assert (d is None) == (wd is None) and (d is None or abs(d - wd) <= 0.051 + 1e-9 * wd)
