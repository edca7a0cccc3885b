"""Operator 4: embedding near-dedup by collision-counting projections.

Every vector is projected on many random lines. Around a query's projection
lies a window on each line; a pair that meets in enough windows is verified by
its cosine. The windows and the count are calibrated for a recall.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import components, register, ship, table, written

ship(__name__)

LINES, KEYS, SEED = 24, 2, 20240229
QUERY_BLOCK, MEMBER_BLOCK = 512, 4096


def _tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2))  # P(|N(0,1)| > z)


def calibrate(threshold: float, recall: float, lines: int = LINES, keys: int = KEYS) -> tuple[float, float, int]:
    """(key window, window, count) for pairs at the threshold itself.

    Unit vectors with cosine c lie sqrt(2 - 2c) apart, and their projections on
    a random Gaussian line differ by a normal of that deviation. The key
    windows lose at most half of 1 - recall; the other lines have windows of
    2.5 deviations, and the count is the largest that loses at most the rest.
    """
    dev = math.sqrt(2 - 2 * threshold)
    loss = (1 - recall) / 2
    z = 2.5
    while keys * _tail(z) > loss:
        z += 0.01
    p = 1 - _tail(2.5)
    n = lines - keys
    count, below = 0, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > loss:
            break
        count = k + 1
    return z * dev, 2.5 * dev, count


def lines_of(dim: int, lines: int = LINES) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, lines))


def _unit(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    # scaled by a power of two first, so that no square under- or overflows
    v = v * np.exp2(-np.frexp(np.abs(v).max(axis=1))[1].astype(float))[:, None]
    return v, v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _vectors(emb: DataFrame, key_window: float, vec_id: str, vector: str, label: str) -> DataFrame:
    """``label, dim, vec, c0, c1`` per row that can link; the cells are key windows wide."""
    src = emb.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    ok = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    src = src.filter(F.coalesce(ok, F.lit(False)))
    schema = T.StructType([src.schema["id"], src.schema["label"], T.StructField("dim", T.IntegerType()),
                           T.StructField("vec", T.BinaryType()), T.StructField("c0", T.LongType()), T.StructField("c1", T.LongType())])

    def run(batches):
        for batch in batches:
            vecs = [np.array(x.as_py(), np.float64) for x in batch.column("v")]
            dims = np.array([len(x) for x in vecs], np.int32)
            cells = np.zeros((len(vecs), 2), np.int64)
            raw = [x.tobytes() for x in vecs]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                _, u = _unit([raw[i] for i in at], int(dim))
                cells[at] = np.floor(u @ lines_of(int(dim))[:, :2] / key_window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(dims), pa.array(raw, pa.binary()),
                 pa.array(cells[:, 0]), pa.array(cells[:, 1])], names=schema.names)

    return src.mapInArrow(run, schema)


def collisions(q: np.ndarray, x: np.ndarray, window: float) -> np.ndarray:
    """In how many lines each member lies in each query's window: the members
    are sorted along each line, and a window is a run of that order."""
    hits = np.zeros((len(q), len(x) + 1), np.int32)
    out = np.zeros((len(q), len(x)), np.int16)
    rows = np.arange(len(q))
    for j in range(q.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        line = x[order, j]
        hits[:] = 0
        hits[rows, np.searchsorted(line, q[:, j] - window, "left")] = 1
        np.add.at(hits, (rows, np.searchsorted(line, q[:, j] + window, "right")), -1)
        out[:, order] += np.cumsum(hits[:, :-1], axis=1, dtype=np.int16)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of the pairs that join what was not joined yet."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def links(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``cid, n, other``: rows with ``n`` count the linked vectors a block found
    for a class; rows with ``other`` are links enough to connect what it found.

    Members meet in blocks of two neighbouring cells (a label's cells split by
    hash into query and member blocks), so no task holds a whole label, and a
    block's output is linear in its members however many links it finds.
    """
    _, window, count = calibrate(threshold, recall)
    cell = ["label", "dim", "c0", "c1"]
    size = classes.groupBy(*cell).agg(F.count(F.lit(1)).alias("g"))
    c = classes.join(size, cell)
    near = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("d0"), F.lit(b).alias("d1")) for a, b in near]))
    to = size.select("label", "dim", F.col("c0").alias("n0"), F.col("c1").alias("n1"), F.col("g").alias("h"))
    pairs = (size.select(*cell, "g", offs.alias("o"))
             .select(*cell, "g", (F.col("c0") + F.col("o.d0")).alias("n0"), (F.col("c1") + F.col("o.d1")).alias("n1"))
             .join(to, ["label", "dim", "n0", "n1"])
             .withColumn("nq", F.ceil(F.col("g") / QUERY_BLOCK)).withColumn("nm", F.ceil(F.col("h") / MEMBER_BLOCK)))
    cut = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    group = ["label", "dim", "c0", "c1", "n0", "n1"]
    body = ["cid", "copies", "vec"]
    q = c.join(pairs.select(*group, "nq", "nm"), cell).select(*group, *body, cut("nq").alias("qb"), span("nm").alias("mb"), F.lit(True).alias("query"))
    m = (c.select("label", "dim", F.col("c0").alias("n0"), F.col("c1").alias("n1"), *body)
         .join(pairs.select(*group, "nq", "nm"), ["label", "dim", "n0", "n1"])
         .select(*group, *body, cut("nm").alias("mb"), span("nq").alias("qb"), F.lit(False).alias("query")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        qs, ms = df[df["query"]], df[~df["query"]]
        if not len(qs) or not len(ms):
            return pd.DataFrame({"cid": [], "n": [], "other": []}).astype({"cid": "int64", "n": "Int64", "other": "Int64"})
        dim = int(df.dim.iloc[0])
        same = (df.c0.iloc[0], df.c1.iloc[0]) == (df.n0.iloc[0], df.n1.iloc[0])
        qv, qu = _unit(list(qs.vec), dim)
        mv, mu = _unit(list(ms.vec), dim)
        base = lines_of(dim)[:, KEYS:]
        qi, mi = qs.cid.to_numpy(), ms.cid.to_numpy()
        met = collisions(qu @ base, mu @ base, window) >= count
        if same:  # each pair of a cell once
            met &= qi[:, None] < mi[None, :]
        a, b = np.nonzero(met)
        good = []
        for s in range(0, len(a), 200_000):
            x, y = qv[a[s:s + 200_000]], mv[b[s:s + 200_000]]
            dot = np.einsum("ij,ij->i", x, y)
            good.append(dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold)
        ok = np.concatenate(good) if good else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        nq = np.bincount(a, weights=ms.copies.to_numpy()[b], minlength=len(qi)).astype(np.int64)
        nm = np.bincount(b, weights=qs.copies.to_numpy()[a], minlength=len(mi)).astype(np.int64)
        keep = _forest(qi[a], mi[b])
        ids = np.concatenate([qi[nq > 0], mi[nm > 0]])
        counts = np.concatenate([nq[nq > 0], nm[nm > 0]])
        none_n, none_o = [None] * len(keep), [None] * len(ids)
        return pd.DataFrame({
            "cid": np.concatenate([ids, qi[a[keep]]]), "n": pd.array([*counts.tolist(), *none_n], "Int64"),
            "other": pd.array([*none_o, *mi[b[keep]].tolist()], "Int64")})

    return (q.unionByName(m.select(*q.columns)).groupBy(*group, "qb", "mb")
            .applyInPandas(run, "cid long, n long, other long"))


def near_vectors(emb: DataFrame, threshold: float = 0.98, recall: float = 0.9999, vec_id: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Vectors of one label (and one length) link at cosine >= ``threshold`` in
    double precision. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, itself included.
    Vectors that are null, empty, zero or hold a null or non-finite component,
    and those without a label, link with nothing. Equal vectors of a label are
    one class (also repeated rows), so a common vector is compared once. Null
    ids count after all others. Extra columns are ignored.
    """
    key_window, _, _ = calibrate(threshold, recall)
    vecs = _vectors(emb, key_window, vec_id, vector, label)
    rows = written(vecs.withColumn("hash", F.unhex(F.md5("vec"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.groupBy("label", "dim", "hash").agg(
        F.min("row").alias("cid"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    of = written(rows.select("row", "id", "label", "dim", "hash").join(classes, ["label", "dim", "hash"])
                 .select("row", "id", "cid", "copies", "least"), "classes")
    one = rows.join(of.filter("row = cid").select("row", "cid", "copies", "least"), "row").select(
        "cid", "copies", "label", "dim", "vec", "c0", "c1")
    found = written(links(one, threshold, recall), "links")
    counts = found.filter("n IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    comp = components(found.filter("other IS NOT NULL"), "cid", "other")
    named = (of.filter("row = cid").select("cid", "least").join(comp, F.col("cid") == F.col("node"), "left")
             .select("cid", "least", F.coalesce("comp", "cid").alias("comp")))
    small = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(small, "comp").join(counts, "cid", "left").select("cid", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    linked = (of.join(by_class, "cid").select(
        F.col("id").alias("vec_id"), (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"))
    usable = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(F.col(vector).cast("array<double>"), lambda x: x != 0) & F.col(label).isNotNull() & (F.size(vector) > 0)
    alone = emb.filter(~F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@register("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark, sf_dir):
    """Near-duplicate vectors of a label at cosine 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
