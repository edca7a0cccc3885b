"""Density clustering against brute force (same core points, same partition of
core points, borders attached to a reachable core)."""

import math
import random

import numpy as np

from hotzone.operators import spatial as SP

R = 6371000.0


def brute(points, eps, m):
    lat = np.radians([p[1] for p in points])
    lon = np.radians([p[2] for p in points])
    dlat = lat[:, None] - lat[None, :]
    dlon = lon[:, None] - lon[None, :]
    a = np.sin(dlat / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat)[None, :] * np.sin(dlon / 2) ** 2
    d = 2 * R * np.arcsin(np.sqrt(a))
    near = d <= eps
    core = near.sum(axis=1) >= m
    n = len(points)
    comp = list(range(n))

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x
    for i in range(n):
        if core[i]:
            for j in np.nonzero(near[i] & core)[0]:
                a_, b_ = find(i), find(int(j))
                if a_ != b_:
                    comp[max(a_, b_)] = min(a_, b_)
    return core, [find(i) for i in range(n)], near


import pytest


@pytest.mark.parametrize("seed,eps,m,sigma", [(7, 120.0, 8, 0.0006), (11, 60.0, 4, 0.0009)])
def test_dbscan_matches_brute_force(spark, seed, eps, m, sigma):
    rnd = random.Random(seed)
    pts = []
    centers = [(12.90, 77.50), (12.9012, 77.5010), (12.95, 77.60)]
    i = 0
    for c in centers:
        for _ in range(60):
            pts.append((i, c[0] + rnd.gauss(0, sigma), c[1] + rnd.gauss(0, sigma)))
            i += 1
    for _ in range(40):  # noise
        pts.append((i, 12.85 + rnd.random() * 0.15, 77.45 + rnd.random() * 0.2))
        i += 1
    for k in range(80):  # a chain of core points about 22 m apart: connectivity across many cells
        pts.append((i, 12.92 + k * 0.0002, 77.55))
        i += 1
    pts += [(i + k, pts[k][1], pts[k][2]) for k in range(5)]  # repeated locations
    df = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    got = {r.id: (r.cluster, r.is_core) for r in SP.dbscan(df, eps, m).collect()}
    core, comp, near = brute(pts, eps, m)
    ids = [p[0] for p in pts]
    # same core points
    assert all(got[ids[k]][1] == bool(core[k]) for k in range(len(pts)))
    # same partition of core points
    pairs_ok = all((got[ids[a]][0] == got[ids[b]][0]) == (comp[a] == comp[b])
                   for a in range(len(pts)) for b in range(len(pts)) if core[a] and core[b])
    assert pairs_ok
    # border points belong to a cluster that has a core point within eps; noise has none
    for k in range(len(pts)):
        if core[k]:
            continue
        reach = [j for j in np.nonzero(near[k] & core)[0]]
        if reach:
            assert got[ids[k]][0] in {got[ids[j]][0] for j in reach}
        else:
            assert got[ids[k]][0] == -1
    assert math.isfinite(len(got))
