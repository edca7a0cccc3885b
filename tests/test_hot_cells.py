"""Reach counts and clustering in hot cells, at the poles and across the date line."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotzone.operators import spatial as SP
from tests.test_dbscan import brute
from tests.test_scale_paths import brute_nearest

R = 6371000.0
SCHEMA = "id long, latitude double, longitude double"


def distances(lat, lon, i):
    la, lo = np.radians(lat), np.radians(lon)
    a = np.sin((la - la[i]) / 2) ** 2 + np.cos(la) * np.cos(la[i]) * np.sin((lo - lo[i]) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(a))


def test_hot_cell_of_100000_locations(spark, monkeypatch):
    """100,000 distinct locations within 106 m and 500 more within 300 m of them."""
    rng = np.random.default_rng(1)
    n = 100_000
    deg = 1 / 111_194.93
    lat = np.concatenate([12.9 + rng.random(n) * 106 * deg, 12.9 + (rng.random(500) * 600 - 250) * deg])
    lon = np.concatenate([77.5 + rng.random(n) * 106 * deg, 77.5 + (rng.random(500) * 600 - 250) * deg])
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"id": range(len(lat)), "latitude": lat, "longitude": lon}))
    met = []
    judge = SP._tested

    def counted(pairs, a, b, metres):
        size = lambda t, c: SP._all(k.select(F.col("cell").alias(c), F.col("n").alias(f"n_{c}")) for k in t.nodes)
        met.append(pairs.join(size(a, "a"), "a").join(size(b, "b"), "b").agg(
            F.max(F.greatest("n_a", "n_b")), F.sum(F.col("n_a") * F.col("n_b"))).first())
        return judge(pairs, a, b, metres)

    monkeypatch.setattr(SP, "_tested", counted)
    got = {r.id: r.n_within for r in SP.eps_neighbour_counts(df, 150.0).collect()}
    assert len(got) == len(lat)
    for i in [*rng.integers(0, n, 60).tolist(), *range(n, n + 120)]:
        assert got[i] == int((distances(lat, lon, i) <= 150.0).sum())
    most, tests = met[0]
    assert most <= SP.LEAF and tests < 0.01 * len(lat) ** 2
    met.clear()
    lab = SP.dbscan(df, 150.0, 20).groupBy("cluster", "is_core").count().collect()
    assert {r.cluster for r in lab if r.is_core} == {0} and sum(r["count"] for r in lab if r.cluster == 0) >= n
    assert all((m[0] or 0) <= SP.LEAF and (m[1] or 0) < 0.001 * len(lat) ** 2 for m in met)


def around(lat, lon, metres, rng, n):
    """n points in a square of 2 x metres around a place; longitudes wrap."""
    a = lat + (rng.random(n) * 2 - 1) * metres / 111_194.93
    o = lon + (rng.random(n) * 2 - 1) * metres / (111_194.93 * math.cos(math.radians(lat)))
    return list(zip(np.clip(a, -90, 90).tolist(), ((o + 180) % 360 - 180).tolist()))


PLACES = [(0.0, 180.0), (-17.0, -179.9999), (89.0, 30.0), (-89.9995, -120.0), (52.0, 0.0), (12.9, 77.5)]


def test_counts_and_clusters_anywhere_on_the_globe(spark):
    rng = np.random.default_rng(4)
    pts = [p for a, o in PLACES for p in around(a, o, 260.0, rng, 60)] + [(90.0, 0.0), (90.0, 77.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0)]
    rows = [(i, a, o) for i, (a, o) in enumerate(pts)]
    df = spark.createDataFrame(rows, SCHEMA)
    core, comp, near = brute(rows, 100.0, 6)
    counts = {r.id: r.n_within for r in SP.eps_neighbour_counts(df, 100.0).collect()}
    assert [counts[i] for i in range(len(rows))] == near.sum(axis=1).tolist()
    got = {r.id: (r.cluster, r.is_core) for r in SP.dbscan(df, 100.0, 6).collect()}
    assert [got[i][1] for i in range(len(rows))] == core.tolist()
    of = {}
    for i in np.flatnonzero(core).tolist():
        assert of.setdefault(comp[i], got[i][0]) == got[i][0] != -1
    assert len(set(of.values())) == len(of)
    for i in np.flatnonzero(~core).tolist():
        reach = {got[int(j)][0] for j in np.flatnonzero(near[i] & core)}
        assert got[i][0] in reach if reach else got[i][0] == -1


def test_nearest_anywhere_on_the_globe(spark):
    rng = np.random.default_rng(6)
    cents = [(i, a, o) for i, (a, o) in enumerate([p for a, o in PLACES for p in around(a, o, 3000.0, rng, 12)])]
    pts = [p for a, o in PLACES for p in around(a, o, 6000.0, rng, 25)] + [(90.0, 10.0), (-90.0, 0.0), (0.0, 90.0), (45.0, -90.0), (0.0, 179.99), (0.0, -179.99)]
    rows = [(i, a, o) for i, (a, o) in enumerate(pts)]
    got = {r.id: (r.cluster, r.dist_centroid_m) for r in SP.assign_nearest(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(cents, "cluster int, lat double, lon double"), 400.0).collect()}
    for (i, _, _), (c, d) in zip(rows, brute_nearest(rows, cents, 400.0)):
        assert got[i][0] == c and abs(got[i][1] - d) <= 0.051 + 1e-9 * d


def test_locations_a_millimetre_apart_and_no_rows(spark):
    rows = [(i, 12.9 + i * 1e-9, 77.5) for i in range(100)] + [(200, None, 77.5), (201, 12.9, None)]
    got = {r.id: r.n_within for r in SP.eps_neighbour_counts(spark.createDataFrame(rows, SCHEMA), 0.001).collect()}
    la = np.array([r[1] for r in rows[:100]])
    lo = np.full(100, 77.5)
    assert [got[i] for i in range(100)] == [int((distances(la, lo, i) <= 0.001).sum()) for i in range(100)]
    assert got[200] is None and got[201] is None
    empty = spark.createDataFrame([], SCHEMA)
    assert SP.eps_neighbour_counts(empty, 100.0).count() == 0 and SP.dbscan(empty, 100.0, 5).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "rings"])
def test_components(spark, shape):
    n = 300
    edges = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n // 2, i) for i in range(n) if i != n // 2],
             "rings": [(i, (i + 1) if (i + 1) % 50 else i - 49) for i in range(n)] + [(3, 3)]}[shape]
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    got = {r.node: r.comp for r in SP.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: i - i % 50 if shape == "rings" else 0 for i in range(n)} | {n: n, n + 1: n + 1}
    assert got == want
