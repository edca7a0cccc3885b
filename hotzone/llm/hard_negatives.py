"""Operator 11: hard-negative mining by a secondary-sort shuffle.

Anchors meet all rows in blocks; a block keeps what can still be among an
anchor's first positives, and then what can still be among the first negatives
of its windows. Those pairs become keys (anchor, descending score, id); the
shuffle deals them out by anchor and sorts them within the partitions, and one
pass over the sorted stream opens a window per positive and emits negatives as
they come, without holding an anchor's pairs.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import register, ship, table, written

ship(__name__)

#: Bytes of unpacked vectors in a block of anchors and in a block of rows, and anchors scored at a time.
ANCHOR_BYTES, ROW_BYTES, AT_ONCE = 1 << 21, 1 << 22, 256
#: Scores, a hundredfold, are exact in doubles below this.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


KEPT = ("id", "no_id", "label", "anchor")


def _usable(src: DataFrame, scale: int) -> DataFrame:
    """``id, no_id, label, anchor, dim, vec`` of the rows that take part; ``vec`` holds the
    components floor(scale * x), as 16-bit numbers where they fit, else as doubles."""
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.filter(F.coalesce(ok, F.lit(False)))
    schema = T.StructType([*[src.schema[c] for c in KEPT], T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType())])

    def run(batches):
        for batch in batches:
            dims, raw, keep = [], [], []
            for i, x in enumerate(batch.column("v")):
                with np.errstate(over="ignore"):
                    v = np.floor(scale * np.array(x.as_py(), np.float64))
                if np.isfinite(v).all():
                    dims.append(len(v))
                    raw.append(v.astype("<i2").tobytes() if (np.abs(v) < 32768).all() else v.astype("<f8").tobytes())
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in KEPT], pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                             names=schema.names)

    return src.mapInArrow(run, schema)


def _unpack(raw: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<f8") for r in raw], np.float64).reshape(len(raw), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where the largest fits, else in Python's integers."""
    if not a.size or not b.size or 100.0 * a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(a).dot(whole(b).T)


def _first(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's first ``k`` valid entries by descending score, then column."""
    if scores.dtype == object:
        picked = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(valid[i]).tolist(), key=lambda j: (-scores[i, j], j))[:k]]
        return np.array([p[0] for p in picked], np.int64), np.array([p[1] for p in picked], np.int64)
    s = np.where(valid, scores, -np.inf)
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        valid = valid & (s >= least[:, None])
    i, j = np.nonzero(valid)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[rank < k], j[rank < k]


def _blocks(anchors: DataFrame, rows: DataFrame, by: list[str], extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Anchors and rows of equal ``by`` dealt into blocks, every block of anchors with every block of rows."""
    part = lambda size: F.greatest(F.lit(16), F.floor(F.lit(size) / (8 * F.greatest("dim", F.lit(1))))).cast("long")
    n = (anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_a")).join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_r")), by)
         .select(*by, F.ceil(F.col("n_a") / part(ANCHOR_BYTES)).alias("n_a"), F.ceil(F.col("n_r") / part(ROW_BYTES)).alias("n_r")))
    cut = lambda c: F.pmod(F.xxhash64("row"), F.col(c))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    body = ["row", "id", "no_id", "label", "vec"]
    group = list(dict.fromkeys([*by, "a_block", "r_block"]))
    group_by = [c if c != "label" else "of_label" for c in group]
    keys = [F.col(c).alias("of_label") if c == "label" else F.col(c) for c in by]
    a = anchors.join(n, by).select(*keys, *body, *extra, cut("n_a").alias("a_block"), span("n_r").alias("r_block"), F.lit(True).alias("query"))
    r = rows.join(n, by).select(*keys, *body, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra],
                                cut("n_r").alias("r_block"), span("n_a").alias("a_block"), F.lit(False).alias("query"))
    return a.unionByName(r), group_by


FOUND = "anchor_row long, anchor_id long, anchor_null boolean, row long, id long, no_id boolean, score long"
PAIR = {"anchor_row": "int64", "anchor_id": "int64", "anchor_null": "bool", "row": "int64", "id": "int64", "no_id": "bool", "score": "int64"}


def _meet(df: pd.DataFrame, pick) -> pd.DataFrame:
    """One pair of blocks: ``pick(scores, anchors, rows)`` names the pairs to keep."""
    a = df[df["query"]].reset_index(drop=True)
    r = df[~df["query"]].sort_values(["no_id", "id", "row"]).reset_index(drop=True)
    out = []
    if len(a) and len(r):
        dim = int(df["dim"].iloc[0])
        rv = _unpack(list(r["vec"]), dim)
        for lo in range(0, len(a), AT_ONCE):
            part = a.iloc[lo:lo + AT_ONCE]
            s = _scores(_unpack(list(part["vec"]), dim), rv)
            i, j = pick(s, part, r)
            out.append(pd.DataFrame({
                "anchor_row": part["row"].to_numpy()[i], "anchor_id": part["id"].to_numpy()[i], "anchor_null": part["no_id"].to_numpy()[i],
                "row": r["row"].to_numpy()[j], "id": r["id"].to_numpy()[j], "no_id": r["no_id"].to_numpy()[j], "score": [min(max(int(x), LONG_MIN), LONG_MAX) for x in s[i, j]]}).astype(PAIR))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in PAIR.items()})


def pair_key(anchor_row: int, score: int, negative: bool, vec_id: int | None, row: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives first, id (nulls last), row."""
    return struct.pack(">QQ?QQ", anchor_row, LONG_MAX - score, negative, LONG_MAX * 2 + 1 if vec_id is None else vec_id - LONG_MIN, row)


class Windows:
    """The windows of the anchor at hand, opened by its positives as the stream passes."""

    def __init__(self, negatives: int, low: int, high: int):
        self.negatives, self.low, self.high = negatives, low, high
        self.anchor = None
        self.open: list[list] = []

    def feed(self, anchor: int, anchor_id: int, negative: bool, vec_id: int | None, score: int):
        """Rows emitted for the next pair of the sorted stream."""
        if anchor != self.anchor:
            self.anchor, self.open = anchor, []
        if not negative:
            self.open.append([vec_id, score, 0])
            return
        for w in self.open:
            if w[2] < self.negatives and self.low * w[1] <= 100 * score <= self.high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], vec_id, w[1], score


def hard_negatives(emb: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the rows of ``emb``. A row's score for an
    anchor is the integer inner product of their components floor(scale * x).
    An anchor's positives are its first ``positives`` other rows of the same
    label by descending score, ties by smaller id. For each, the first
    ``negatives`` rows of another label with ``low * p <= 100 * n <= high * p``
    are returned in order, ``rank`` from 1.

    Rows with a null label, a null vector, a null or non-finite component, or
    one whose scaled value overflows a double take no part. Vectors of different
    lengths are not compared. Repeated rows are rows of their own ("other" means
    another row, not another id), ties between equal ids go by row; null ids
    come after all others and are returned as null. An anchor without positives
    or negatives gives no rows, nor does an empty table; other columns are
    ignored. Scores beyond 64 bits are held at the range's ends.

    Labels and anchors are dealt into blocks by a hash, so no task holds a whole
    label; a block passes on at most ``positives`` and ``positives * negatives``
    pairs an anchor, which is enough for the exact answer.
    """
    src = emb.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(0)).alias("id"), F.col(vec_id).isNull().alias("no_id"), F.col(label).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                     F.col(vector).cast("array<double>").alias("v"))
    rows = written(_usable(src, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.filter("anchor")

    def best(s, a, r):
        same = (a["label"].to_numpy()[:, None] == r["label"].to_numpy()[None, :]) & (a["row"].to_numpy()[:, None] != r["row"].to_numpy()[None, :])
        return _first(s, same, positives)

    met, by = _blocks(queries, rows, ["dim", "label"], [])
    found = met.groupBy(*by).applyInPandas(lambda df: _meet(df, best), FOUND)
    one = F.struct((-F.col("score")).alias("s"), F.col("no_id").alias("n"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("score").alias("score"))
    pos = written(found.groupBy("anchor_row", "anchor_id", "anchor_null").agg(F.slice(F.sort_array(F.collect_list(one)), 1, positives).alias("p")), "positives")

    def inside(s, a, r):
        other = a["label"].to_numpy()[:, None] != r["label"].to_numpy()[None, :]
        hundred = s * 100
        keep = []
        for k in range(positives):
            p = [int(w[k]) if len(w) > k else None for w in a["windows"]]
            has = np.array([x is not None for x in p])
            # without a positive: a window that nothing is in
            lo = np.array([low * x if h else 1 for x, h in zip(p, has)], s.dtype)[:, None]
            hi = np.array([high * x if h else 0 for x, h in zip(p, has)], s.dtype)[:, None]
            i, j = _first(s, other & (hundred >= lo) & (hundred <= hi), negatives)
            keep.append(i * len(r) + j)
        at = np.unique(np.concatenate(keep))
        return at // len(r), at % len(r)

    windowed = queries.join(pos.select(F.col("anchor_row").alias("row"), F.transform("p", lambda x: x["score"]).alias("windows")), "row")
    met, by = _blocks(windowed, rows, ["dim"], ["windows"])
    near = met.groupBy(*by).applyInPandas(lambda df: _meet(df, inside), FOUND).select("*", F.lit(True).alias("negative"))
    first = pos.select("anchor_row", "anchor_id", "anchor_null", F.explode("p").alias("x")).select(
        "anchor_row", "anchor_id", "anchor_null", F.col("x.row").alias("row"), F.col("x.id").alias("id"), F.col("x.n").alias("no_id"), F.col("x.score").alias("score"), F.lit(False).alias("negative"))

    def keyed(batches):
        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("anchor_row", "score", "negative", "id", "row")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pair_key(*x) for x in zip(*c)], pa.binary())], names=[*batch.schema.names, "key"])

    def stream(batches):
        windows = Windows(negatives, low, high)
        for batch in batches:
            c = [batch.column(n).to_pylist() for n in ("anchor_row", "anchor_id", "negative", "id", "score")]
            out = [x for pair in zip(*c) for x in windows.feed(*pair)]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == 2 else pa.int64()) for k, v in enumerate(cols)], names=RESULT)

    null = lambda flag, c: F.when(~F.col(flag), F.col(c)).alias(c)
    pairs = near.unionByName(first).select("anchor_row", null("anchor_null", "anchor_id"), "row", null("no_id", "id"), "score", "negative")
    dealt = (pairs.mapInArrow(keyed, T.StructType([*pairs.schema.fields, T.StructField("key", T.BinaryType())]))
             .repartition("anchor_row").sortWithinPartitions("key"))
    return dealt.mapInArrow(stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

HARD_NEGATIVES_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), neg AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


@register("op11_hard_negatives", sql=HARD_NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector, against all of them."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(emb, F.col("vec_id") % 50 == 0)
