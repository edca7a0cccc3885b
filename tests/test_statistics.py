"""Statistics by bit sets, two-level modes and running totals against plain Python."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from hotzone.operators import aggregates as AG
from hotzone.operators import scoring as SC

SCHEMA = ("id long, cluster int, created_datetime timestamp, impact double, lanes_blocked double, is_peak boolean, is_weekend boolean, "
          "validation_weight double, scita_weight double, compound_score double, device_type string, police_station string, "
          "final_vehicle_type string, junction_name string, latitude double, longitude double")


def rows_of(spark, n=1500, days=500, seed=2):
    r = random.Random(seed)
    start = dt.datetime(2023, 11, 20)
    pick = lambda *v: r.choice(v)
    rows = [(i, pick(-1, 0, 1, 2, 3), start + dt.timedelta(minutes=r.randint(0, days * 1440)), pick(None, 1.0, 2.5, 3.25), pick(1.0, 2.0, None), pick(True, False),
             pick(True, False), pick(1.5, 1.0), pick(1.2, 0.9, None), pick(0.7, 1.0, 1.3), pick("fixed_camera", "patrol"), pick("a", "b", "c", None),
             pick("x", "y", None), pick("BTP1 - J", "No Junction", None), 12.9, 77.5) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("created_datetime")).withColumn("week", F.weekofyear("date"))
    return rows, df


def top(values):
    n = Counter(v for v in values if v is not None)
    return min(n, key=lambda v: (-n[v], v)) if n else None


def expected(rows, by_year=False):
    week = lambda t: t.isocalendar()[:2] if by_year else t.isocalendar()[1]
    return (len([1 for r in rows if r[3] is not None]), round(sum(r[3] or 0 for r in rows), 6), len({r[2].date() for r in rows}), len({week(r[2]) for r in rows}),
            round(sum(r[5] for r in rows) / len(rows), 9), top(r[11] for r in rows))


def got_of(r):
    return (r.violation_count, round(r.total_impact, 6), r.active_days, r.active_weeks, round(r.peak_pct, 9), r.police_station)


def test_window_stats_count_days_and_weeks(spark):
    rows, df = rows_of(spark)
    for by_year in (False, True):
        got = {r.cluster: got_of(r) for r in AG.window_stats(df, ["cluster"], by_year).collect()}
        assert got == {c: expected([r for r in rows if r[1] == c], by_year) for c in (-1, 0, 1, 2, 3)}


def test_modes(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, None, 3), (2, None, 1), (3, "z", None), (3, "z", 7), (3, "a", 8)], "g int, s string, n int")
    got = {r.g: (r.s, r.n) for r in AG.modes(df, ["g"], {"s": F.col("s"), "n": F.col("n")}).collect()}
    assert got == {1: ("a", "5"), 2: (None, "1"), 3: ("z", "7")}
    assert AG.modes(df.filter("false"), ["g"], {"s": F.col("s")}).count() == 0


def test_running_windows_equal_one_by_one(spark):
    rows, df = rows_of(spark, 900, 40, 5)
    r = random.Random(8)
    for days, unit in ((1, 3600), (2, 60), (9, 86400), (30, 1)):
        ticks = [dt.datetime(2023, 11, 22) + dt.timedelta(seconds=unit * (r.randint(0, 40 * 86400) // unit)) for _ in range(25)]
        ticks += [dt.datetime(2022, 1, 1), dt.datetime(2026, 1, 1), ticks[0]]
        out = SC.score_ticks(spark, df, ticks, days).collect()
        got = {(x.recalculated_at, x.cluster): got_of(x) for x in out}
        assert len(got) == len(out)
        want = {}
        for t in set(ticks):
            for c in range(4):
                inside = [x for x in rows if x[1] == c and t - dt.timedelta(days=days) <= x[2] < t]
                if inside:
                    want[t, c] = expected(inside)
        assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sets_or_maps_and_no_range_join(spark, monkeypatch):
    _, df = rows_of(spark, 100)
    kept = []
    save = SC.saved
    monkeypatch.setattr(SC, "saved", lambda d, name: kept.append((name, plan(d))) or save(d, name))
    SC.score_ticks(spark, df, [dt.datetime(2024, 1, 1)], 30)
    plans = [plan(AG.zone_stats(df)), plan(AG.window_stats(df, ["cluster"])), *[p for _, p in kept]]
    assert len(plans) >= 4
    for p in plans:
        assert "ObjectHashAggregate" not in p or p.count("ObjectHashAggregate") == p.count("ObjectHashAggregate(keys=[], ")  # the one row of ticks
        assert "collect_set" not in p and "mode(" not in p
    loops = [p.count("BroadcastNestedLoopJoin") for _, p in kept]
    assert max(loops) <= 1  # the one row of ticks
