"""Spatial operators: haversine joins, density clustering, centroids and
nearest-centroid assignment (C1-C6).

Design for scale
----------------
* Rows are first collapsed to distinct locations with a weight (map-side
  combined), so a location or a street corner holding a third of all rows is
  one row with a large weight, never a hot group of pairs.
* Locations are points on a sphere in three dimensions, in cubic cells. The
  straight line between two points (the chord) grows with their distance, so
  boxes of cells bound distances anywhere: poles and the date line need no
  special case.
* Cells form an adaptive tree: a cell with more than ``LEAF`` locations is
  split in eight (about four of them meet the surface). Two cells are wholly
  within reach (their weight is added, or they are joined), out of reach, or
  both are split; only cells of at most ``LEAF`` locations are tested pair by
  pair, however many locations a place holds.
* Density clusters are the connected components of the *cell* graph of core
  cells, found by star contraction over written edges. Only counts reach the
  driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotzone import params as P
from hotzone.functions.scalar import haversine_m
from hotzone.session import saved

R = P.EARTH_RADIUS_M
#: Cells of at most so many locations are not split.
LEAF = 32
#: A root cell can be halved so many times.
DEPTH = 20
#: What rounding can add to or take from a chord, with a wide margin.
SLACK_M = 1e-6
AXES = ("x", "y", "z")
BOX = [f"{c}{e}" for c in AXES for e in "01"]


def chord_m(metres: float) -> float:
    """Straight-line length between two points of the sphere ``metres`` apart."""
    return 2.0 * R * math.sin(min(metres / (2.0 * R), math.pi / 2.0))


def on_sphere(df: DataFrame, side: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``df`` with x, y, z in metres and qx, qy, qz, the cell numbers at the finest level of cells of ``side``."""
    df = df.withColumns({"x": F.expr(f"cos(radians({lat})) * cos(radians({lon})) * {R!r}D"), "y": F.expr(f"cos(radians({lat})) * sin(radians({lon})) * {R!r}D"),
                         "z": F.expr(f"sin(radians({lat})) * {R!r}D")})
    return df.withColumns({f"q{c}": F.expr(f"CAST(floor({c} / {side / 2.0**DEPTH!r}D) AS BIGINT)") for c in AXES})


def _cell(level: str, of) -> str:
    return f"named_struct('l', {level}, " + ", ".join(f"'{c}', {of(c)}" for c in AXES) + ")"


def cell_at(level: int) -> Column:
    """A location's cell at a level (0: the root)."""
    return F.expr(_cell(str(level), lambda c: f"shiftright(q{c}, {DEPTH - level})"))


def _above(cell: str, levels: int = 1) -> Column:
    return F.expr(_cell(f"{cell}.l - {levels}", lambda c: f"shiftright({cell}.{c}, {levels})"))


def _around(cell: str) -> Column:
    """The 27 cells in reach of a cell, itself included, as rows."""
    steps = "array(-1L, 0L, 1L)"
    one = _cell(f"{cell}.l", lambda c: f"{cell}.{c} + d{c}")
    return F.expr(f"explode(flatten(transform({steps}, dx -> flatten(transform({steps}, dy -> transform({steps}, dz -> {one}))))))")


def locations(points: DataFrame, lat: str = "latitude", lon: str = "longitude", key: str = "id") -> DataFrame:
    """Distinct locations with weight (rows) and smallest key; rows without coordinates have none."""
    return points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        F.col(lat).alias("latitude"), F.col(lon).alias("longitude")).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("min_id"))


@dataclass(frozen=True)
class Tree:
    """Locations in cells. ``nodes`` holds a table per level from 1 on: cell,
    parent, leaf, n (locations), v (their value: total weight, or what
    :meth:`valued` gives) and the box of the locations in it."""

    locs: DataFrame
    nodes: tuple[DataFrame, ...]
    chord: float

    @property
    def units(self) -> DataFrame:
        """Cells of level 1. All locations of a unit are within reach of each other."""
        return self.nodes[0]

    def valued(self, of_unit: DataFrame) -> Tree:
        """The same cells with ``v`` by unit (``unit, v``) instead of the weight."""
        nodes = tuple(n.drop("v").withColumn("unit", _above("cell", k)).join(of_unit, "unit").drop("unit") for k, n in enumerate(self.nodes))
        return replace(self, nodes=nodes, locs=self.locs.drop("v").withColumn("unit", cell_at(1)).join(of_unit, "unit").drop("unit"))

    def in_cells(self) -> DataFrame:
        """Every location with each of its cells of the tree (and more, below its leaf)."""
        return self.locs.withColumn("cell", F.explode(F.array(*[cell_at(k + 1) for k in range(len(self.nodes))])))

    def in_leaves(self) -> DataFrame:
        """Every location with its leaf."""
        if len(self.nodes) == 1:
            return self.locs.withColumn("cell", cell_at(1))
        leaves = _all(n.filter("leaf").select("cell") for n in self.nodes)
        return self.in_cells().join(leaves, "cell", "left_semi")

    def _side(self, name: str, key: str, df: DataFrame, of: str) -> DataFrame:
        return df.selectExpr(f"{of} AS {key}", f"cell AS {name}", *[f"{c} AS {name}_{c}" for c in ("leaf", "v", *BOX)])

    def first(self, name: str, key: str) -> DataFrame:
        return self._side(name, key, self.units, "parent")

    def next(self, name: str, key: str) -> DataFrame:
        """What a cell is split into, by cell; a leaf stays itself."""
        parts = [self._side(name, key, n, "parent") for n in self.nodes[1:]]
        return _all([*parts, *(self._side(name, key, n.filter("leaf"), "cell") for n in self.nodes)])


def _all(frames) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tree(locs: DataFrame, metres: float) -> Tree:
    """The tree of ``locs`` (latitude, longitude, w, ...) for a reach of ``metres``.

    Level by level, only the locations of cells with more than ``LEAF`` of them
    are grouped again; a count of those cells ends the loop.
    """
    chord = chord_m(metres)
    locs = saved(on_sphere(locs, max(chord * (1.0 + 1e-6) + 4.0 * SLACK_M, 1e-6)).withColumn("v", F.col("w")), "locations")
    nodes, inside, level = [], locs, 1
    while True:
        n = (inside.groupBy(cell_at(level).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"),
            *[F.expr(f"{f}({c}) AS {c}{e}") for c in AXES for e, f in enumerate(("min", "max"))])
            .withColumn("parent", _above("cell")).withColumn("leaf", (F.col("n") <= LEAF) | F.lit(level == DEPTH)))
        n = saved(n, f"cells{level}")
        nodes.append(n)
        hot = n.filter(~F.col("leaf"))
        if hot.isEmpty():
            return Tree(locs, tuple(nodes), chord)
        inside = inside.withColumn("cell", cell_at(level)).join(hot.select("cell"), "cell", "left_semi").drop("cell")
        level += 1


def _judged(pairs: DataFrame, chord: float) -> DataFrame:
    """Pairs of cells that are not out of reach; ``sure`` if wholly within it, ``leaf`` if to be tested."""
    near = " + ".join(f"pow(greatest(0D, a_{c}0 - b_{c}1, b_{c}0 - a_{c}1), 2)" for c in AXES)
    far = " + ".join(f"pow(greatest(a_{c}1 - b_{c}0, b_{c}1 - a_{c}0), 2)" for c in AXES)
    return (pairs.filter(f"{near} <= {(chord + SLACK_M) ** 2!r}D")
            .selectExpr("*", f"{far} <= {max(chord - SLACK_M, 0.0) ** 2!r}D AS sure", "a_leaf AND b_leaf AS leaf")
            .drop(*[f"{s}_{c}" for s in "ab" for c in BOX], "a_leaf", "b_leaf", "a_v"))


def _unit_pairs(a: Tree, b: Tree) -> DataFrame:
    """Pairs of units that are not out of reach."""
    of = lambda t, name: t.units.select(F.col("parent").alias(name)).distinct()
    roots = of(a, "ra").select("ra", _around("ra").alias("rb")).join(of(b, "rb"), "rb")
    return roots.join(a.first("a", "ra"), "ra").join(b.first("b", "rb"), "rb").drop("ra", "rb")


def _split(pairs: DataFrame, a: Tree, b: Tree) -> DataFrame:
    todo = pairs.filter(~F.col("sure") & ~F.col("leaf")).drop("sure", "leaf", "b_v").withColumnRenamed("a", "ka").withColumnRenamed("b", "kb")
    return todo.join(a.next("a", "ka"), "ka").join(b.next("b", "kb"), "kb").drop("ka", "kb")


def _descend(a: Tree, b: Tree) -> tuple[DataFrame, DataFrame]:
    """Cell pairs wholly within reach (``a, b, b_v``), and pairs of leaves to test (``a, b``)."""
    cur = saved(_judged(_unit_pairs(a, b), a.chord), "cell_pairs")
    sure, leaf = [], []
    for k in range(max(len(a.nodes), len(b.nodes))):
        if k:
            cur = saved(_judged(_split(cur, a, b), a.chord), "cell_pairs")
        sure.append(cur.filter("sure").select("a", "b", "b_v"))
        leaf.append(cur.filter(~F.col("sure") & F.col("leaf")).select("a", "b"))
    return _all(sure), _all(leaf)


def _tested(pairs: DataFrame, a: Tree, b: Tree, metres: float) -> DataFrame:
    """Location pairs within ``metres`` from pairs of leaves: latitude, longitude of a, and v of b."""
    la = a.in_leaves().select(F.col("cell").alias("a"), "latitude", "longitude")
    lb = b.in_leaves().select(F.col("cell").alias("b"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), "v")
    return pairs.join(la, "a").join(lb, "b").filter(haversine_m("latitude", "longitude", "t_lat", "t_lon") <= metres)


def reached(a: Tree, b: Tree, metres: float, agg) -> DataFrame:
    """``latitude, longitude, v`` per location of ``a`` that reaches one of
    ``b``: ``agg`` (sum or min) over the values of all it reaches."""
    sure, leaf = _descend(a, b)
    by_cell = sure.groupBy(F.col("a").alias("cell")).agg(agg("b_v").alias("v"))
    whole = a.in_cells().select("cell", "latitude", "longitude").join(by_cell, "cell").select("latitude", "longitude", "v")
    one_by_one = _tested(leaf, a, b, metres).groupBy("latitude", "longitude").agg(agg("v").alias("v"))
    return whole.unionByName(one_by_one).groupBy("latitude", "longitude").agg(agg("v").alias("v"))


def eps_neighbour_counts(points: DataFrame, eps_m: float = P.DBSCAN_EPS_M, key: str = "id") -> DataFrame:
    """For every row, the number of rows within ``eps_m`` metres, itself included
    (C2); null for rows without coordinates.

    The distance self-join never emits all pairs: rows are collapsed to
    locations and whole cells within reach are added by weight.
    """
    t = tree(locations(points, key=key), eps_m)
    counts = reached(t, t, eps_m, F.sum).withColumnRenamed("v", "n_within")
    return points.select(key, "latitude", "longitude").join(counts, ["latitude", "longitude"], "left")


def within_distance(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs (a row, b row) at most ``metres`` apart (C2 as a join): an equi-join
    on the 27 cells around each row of ``a``, plus a haversine filter. Emits
    every qualifying pair, so use it for sparse sides; for counts use
    :func:`eps_neighbour_counts`. Rows without coordinates meet nothing."""
    side = max(chord_m(metres) * (1.0 + 1e-6) + 4.0 * SLACK_M, 1e-6)
    work = [*AXES, *[f"q{c}" for c in AXES]]
    ea = on_sphere(a, side).withColumn("_at", cell_at(0)).withColumn("_cell", _around("_at")).drop("_at", *work)
    bb = on_sphere(b, side).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], cell_at(0).alias("_cell"))
    j = ea.join(bb, "_cell").drop("_cell")
    return j.filter(haversine_m("latitude", "longitude", "b_latitude", "b_longitude") <= metres)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component label (smallest node id) per node of an undirected graph.

    nodes: ``node``; edges: ``src, dst``. Star contraction: in turn, every node
    hands its larger neighbours, then its smaller ones, to the smallest of its
    neighbourhood, until each component is a star around its smallest node. A
    long chain halves in every round. The edges left are written each round; a
    round that leaves their count and exact hash sum unchanged changed nothing:
    that is the stopping test, and the only one: there is no cap on the rounds.
    A star's centre is combined map-side, and its join is one that AQE splits.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()
    last = None
    while True:
        e = saved(e, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
        around = both(e)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = around.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        below = larger.groupBy("b").agg(F.min("a").alias("m"))
        down = larger.join(below, "b")
        e = (down.select(F.col("m").alias("a"), "b").unionByName(down.select(F.col("m").alias("a"), F.col("a").alias("b")))
             .filter("a < b").distinct())
    star = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp"))
    return nodes.select("node").join(star, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _unit_edges(t: Tree, metres: float) -> DataFrame:
    """``ua, ub``: units of ``t`` that hold a pair of locations within reach.

    One such pair is enough: a level at which two cells lie wholly within reach
    settles their units, and what else was open between these is dropped.
    """
    first = _unit_pairs(t, t).filter(F.col("a") < F.col("b"))
    cur = saved(_judged(first, t.chord).withColumn("ua", F.col("a")).withColumn("ub", F.col("b")), "unit_pairs")
    done, leaf = [], []
    for k in range(len(t.nodes)):
        if k:
            left = cur.join(done[-1], ["ua", "ub"], "left_anti")
            cur = saved(_judged(_split(left, t, t), t.chord), "unit_pairs")
        done.append(cur.filter("sure").select("ua", "ub").distinct())
        leaf.append(cur.filter(~F.col("sure") & F.col("leaf")).select("ua", "ub", "a", "b"))
    settled = _all(done).distinct()
    found = _tested(_all(leaf).join(settled, ["ua", "ub"], "left_anti"), t, t, metres).select("ua", "ub").distinct()
    return settled.unionByName(found)


def dbscan_locations(points: DataFrame, eps_m: float = P.DBSCAN_EPS_M,
                     min_samples: int = P.DBSCAN_MIN_SAMPLES, key: str = "id") -> DataFrame:
    """Density clustering of locations (C3): latitude, longitude, w, min_id,
    is_core, cluster (-1 for noise).

    A point is core when at least ``min_samples`` rows (itself included) lie
    within ``eps_m`` (``<=``, haversine). Clusters are numbered 0.. by their
    smallest member key; a border point joins the cluster with the smallest
    label among its core neighbours (the original takes whichever it met first).
    Labels are the smallest member keys of the clusters' core points.
    """
    everything = tree(locations(points, key=key), eps_m)
    units = everything.units.select(F.col("cell").alias("unit"), F.col("v").alias("unit_w"))
    locs = everything.locs.select("latitude", "longitude", "w", "min_id", cell_at(1).alias("unit")).join(units, "unit").drop("unit")
    cols = ["latitude", "longitude", "w", "min_id"]
    dense = locs.filter(F.col("unit_w") >= min_samples).select(*cols, F.lit(True).alias("is_core"))
    sparse = locs.filter(F.col("unit_w") < min_samples).select(*cols)
    within = reached(tree(sparse, eps_m), everything, eps_m, F.sum)
    sparse = sparse.join(within, ["latitude", "longitude"], "left").select(*cols, (F.coalesce("v", F.lit(0)) >= min_samples).alias("is_core"))
    labelled = saved(dense.unionByName(sparse), "labelled")

    # cell graph: nodes are units holding a core point, edges join units with a core pair within reach
    core = tree(labelled.filter("is_core").select(*cols), eps_m)
    unit = core.locs.groupBy(cell_at(1).alias("unit")).agg(F.min("min_id").alias("first"))
    unit = saved(unit.withColumn("node", F.monotonically_increasing_id()), "units")
    name = lambda end, to: unit.select(F.col("unit").alias(end), F.col("node").alias(to))
    edges = _unit_edges(core, eps_m).join(name("ua", "src"), "ua").join(name("ub", "dst"), "ub").select("src", "dst")
    comps = connected_components(unit.select("node"), edges)
    of = unit.join(comps, "node")
    least = of.groupBy("comp").agg(F.min("first").alias("v"))
    of_unit = saved(of.join(least, "comp").select("unit", "v"), "unit_labels")

    core_lab = core.locs.drop("v").withColumn("unit", cell_at(1)).join(of_unit, "unit").select(*cols, F.lit(True).alias("is_core"), "v")
    # border points: non-core locations with a core location in reach; the smallest label wins
    noncore = labelled.filter(~F.col("is_core"))
    reach = reached(tree(noncore.select(*cols), eps_m), core.valued(of_unit), eps_m, F.min)
    border = noncore.join(reach, ["latitude", "longitude"], "left").select(*cols, "is_core", "v")
    all_lab = saved(core_lab.unionByName(border), "labels")
    # number clusters 0.. by smallest member key (distributed ordinal over the cluster table)
    first = all_lab.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("min_id").alias("_first"))
    from hotzone.operators.ranking import ordinal

    numbered = ordinal(first, ["_first"], "_ord").withColumn("cluster", (F.col("_ord") - 1).cast("int"))
    return (all_lab.join(numbered.select("v", "cluster"), "v", "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(-1))).drop("v"))


def dbscan(points: DataFrame, eps_m: float = P.DBSCAN_EPS_M, min_samples: int = P.DBSCAN_MIN_SAMPLES,
           key: str = "id") -> DataFrame:
    """Rows of ``points`` with ``cluster`` and ``is_core`` (C3); -1 and false for
    rows without coordinates. The join back to rows is on the location; AQE
    splits a location that holds very many rows."""
    lab = dbscan_locations(points, eps_m, min_samples, key).select("latitude", "longitude", "cluster", "is_core")
    return (points.join(lab, ["latitude", "longitude"], "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(-1))).withColumn("is_core", F.coalesce("is_core", F.lit(False))))


def sample_n(df: DataFrame, n: int, seed: int = P.DBSCAN_SEED, key: str = "id") -> DataFrame:
    """Deterministic sample of n rows: the n smallest ``md5(key:seed)`` (C4).
    TakeOrderedAndProject keeps n rows per task; n is the sampling parameter."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def centroids(labelled: DataFrame) -> DataFrame:
    """Mean latitude and longitude per cluster, noise excluded."""
    from hotzone.operators.aggregates import EXACT_COORD, exact_avg

    return (labelled.filter(F.col("cluster") != -1).groupBy("cluster")
            .agg(exact_avg("latitude", EXACT_COORD).alias("lat"), exact_avg("longitude", EXACT_COORD).alias("lon")))


#: Levels with at most so many cells are broadcast.
BROADCAST_CELLS = 65_536


def _nearest_far(locs: DataFrame, cents: DataFrame, leaf_m: float) -> DataFrame:
    """Nearest centroid of locations that have none close by: latitude, longitude, best(d, c).

    A search from coarse to fine cells on the sphere. Each level splits the
    cells still in question; a cell stays if the shortest chord to its box does
    not exceed the chord to some centroid met at that level (a cell's
    representative). So a location meets a few cells per level, never all
    centroids. A level has at most 64 times the cells of the one above, and no
    more than centroids; only levels within ``BROADCAST_CELLS`` are broadcast.
    """
    c = on_sphere(cents.withColumnRenamed("a", "latitude").withColumnRenamed("o", "longitude"), leaf_m)
    ext = c.agg(F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{m}{e}") for m in AXES for e, f in (("0", F.min), ("1", F.max))]).first()
    n = ext["n"]
    if not n:
        return locs.select("latitude", "longitude", F.lit(None).cast("struct<d:double,c:int>").alias("best"))
    side = max(leaf_m, *[ext[f"{m}1"] - ext[f"{m}0"] for m in AXES]) * (1.0 + 1e-6)  # one cell holds all centroids
    levels = max(1, min(DEPTH, math.ceil(math.log(side / leaf_m, 4))))
    number = lambda m, k: f"CAST(floor(({m} - {ext[f'{m}0']!r}D) / {side / 4.0**k!r}D) AS BIGINT)" if k else "0L"
    up = lambda k: F.expr(_cell(str(k), lambda m: number(m, k)))
    cand = on_sphere(locs.select("latitude", "longitude"), leaf_m).select(
        "latitude", "longitude", *[F.col(m).alias(f"m{m}") for m in AXES], up(0).alias("at"))
    near = "sqrt(" + " + ".join(f"pow(greatest(0D, {m}0 - m{m}, m{m} - {m}1), 2)" for m in AXES) + ")"
    met = "sqrt(" + " + ".join(f"pow(rep.{m} - m{m}, 2)" for m in AXES) + ")"
    for k in range(1, levels + 1):
        cells = c.groupBy(up(k - 1).alias("at"), up(k).alias("cell")).agg(
            *[F.expr(f"{f}({m}) AS {m}{e}") for m in AXES for e, f in enumerate(("min", "max"))], F.expr("min(struct(x, y, z)) AS rep"))
        if min(n, 64**k) <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        step = cand.join(cells, "at").selectExpr("latitude", "longitude", "mx", "my", "mz", "cell AS at", f"{near} AS near", f"{met} AS met")
        step = step.withColumn("most", F.min("met").over(Window.partitionBy("latitude", "longitude")))
        cand = step.filter(F.col("near") <= F.col("most") + SLACK_M).drop("near", "met", "most")
    leaf = c.select(up(levels).alias("at"), F.col("latitude").alias("a"), F.col("longitude").alias("o"), "c")
    return (cand.join(leaf, "at").groupBy("latitude", "longitude")
            .agg(F.min(F.struct(haversine_m("latitude", "longitude", "a", "o").alias("d"), "c")).alias("best")))


def assign_nearest(df: DataFrame, cents: DataFrame, max_m: float = P.ASSIGN_MAX_M) -> DataFrame:
    """Nearest centroid within ``max_m`` metres, else -1; the distance to the
    nearest centroid is kept for every row, rounded half-even to 0.1 m after
    the test (C6). Rows without coordinates get -1 and no distance; ties go to
    the smaller cluster; every row stays, equal rows included.

    One algorithm for any number of centroids, on distinct locations: a grid
    equi-join finds the centroids within ``max_m``; the locations with none
    search the cells of the centroids from coarse to fine. The result is
    joined back on the location (AQE splits a hot one).
    """
    cents = cents.select(F.col("cluster").cast("int").alias("c"), F.col("lat").alias("a"), F.col("lon").alias("o"))
    cents = saved(cents.filter(F.col("a").isNotNull() & F.col("o").isNotNull()), "centroids")
    at = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    locs = saved(df.filter(at).select("latitude", "longitude").distinct(), "locations")
    near = within_distance(cents.select("c", F.col("a").alias("latitude"), F.col("o").alias("longitude")), locs, max_m)
    d = haversine_m("b_latitude", "b_longitude", "latitude", "longitude")
    found = saved(near.groupBy(F.col("b_latitude").alias("latitude"), F.col("b_longitude").alias("longitude"))
                   .agg(F.min(F.struct(d.alias("d"), "c")).alias("best")), "nearest")
    rest = locs.join(found, ["latitude", "longitude"], "left_anti")
    best = found.unionByName(_nearest_far(rest, cents, max_m)).select(
        F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"), F.col("best").alias("_best"))
    j = df.join(best, (df["latitude"] == F.col("_la")) & (df["longitude"] == F.col("_lo")), "left").drop("_la", "_lo")
    return (j.withColumn("cluster", F.when(F.col("_best.d") <= max_m, F.col("_best.c")).otherwise(F.lit(-1)))
            .withColumn("dist_centroid_m", F.rint(F.col("_best.d") * 10.0) / 10.0).drop("_best"))
