"""Operator 6: MinHash near-dedup with compressed registers (HyperMinHash).

One hash per shingle picks a bucket by its leading bits; a bucket keeps its
smallest remainder as a leading-zero count plus mantissa bits. Bands of
registers give candidates, a collision-corrected Jaccard estimate prunes
them, and full shingle sets verify them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hotzone.llm.common import components, drop, free_name, register, ship, table, text_key, written
from hotzone.llm.shingles import WordHashes, mix, shingle_set

ship(__name__)

U = np.uint64
BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
#: registers a band holds, for sets that use at least and fewer than so many registers. The ranges overlap by
#: more than two sets at the threshold can differ, so every such pair has a width in common.
WIDTHS = ((4, 1, 18), (12, 12, 96), (6, 64, BUCKETS + 1))
SIGMAS = 5.0
QUERY_BLOCK, MEMBER_BLOCK, PAIR_BLOCK = 512, 4096, 16384
SET_BLOCK = 1 << 21  # shingles that the members of a block hold
BLOCK = ["band", "qb", "mb"]
BITMAP = 32768  # bits of one bitmap that Spark makes


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased text."""
    return text.encode().lower().split() if text else []


def registers(s: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set of 64-bit hashes: 0 for an empty
    bucket, else 1 + leading zeros * 2^mantissa bits + mantissa of its minimum."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(s) == 0:
        return out
    b = (s >> U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    rest = 64 - BUCKET_BITS
    v = s[first] & U((1 << rest) - 1)
    v = v >> U(rest - 52)  # exact in a double
    mant, exp = np.frexp(v.astype(np.float64))  # v = mant * 2^exp, mant in [0.5, 1)
    frac = ((mant * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64) * (v > 0)
    out[b[first]] = (1 + np.minimum(52 - exp, 62) * (1 << MANTISSA_BITS) + np.maximum(frac, 0)).astype(np.uint16)
    return out


def band_hashes(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key per band that has a register in use. The fewer registers
    a set uses, the wider its bands, so that a key stands for several shingles;
    the smallest sets have narrow ones, of a shingle each."""
    return _bands(reg)[0]


def _bands(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``band_hashes`` and the band's number of each."""
    n, out, nos = np.count_nonzero(reg), [np.zeros(0, U)], [np.zeros(0, np.int32)]
    for k, (width, least, below) in enumerate(WIDTHS):
        if least <= n < below:
            r = reg[: BUCKETS // width * width].reshape(-1, width)
            key = mix(np.arange(1, len(r) + 1, dtype=U) + U(width << 32))
            for j in range(width):
                key = mix(key * U(0x100000001B3) + r[:, j].astype(U))
            used = r.any(axis=1)
            out.append(key[used])
            nos.append(np.flatnonzero(used).astype(np.int32) + k * BUCKETS)
    return np.concatenate(out).view(np.int64), np.concatenate(nos)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two register arrays, the number of the first band both have; -1 if none."""
    out = np.full(len(a), -1, np.int32)
    na, nb = (np.count_nonzero(x, axis=1) for x in (a, b))
    same = a == b
    for k, (width, least, below) in enumerate(WIDTHS):
        m = BUCKETS // width
        both = (same[:, : m * width].reshape(-1, m, width).all(axis=2)
                & a[:, : m * width].reshape(-1, m, width).any(axis=2))
        at = np.where(both.any(axis=1), both.argmax(axis=1), -1)
        ok = (out < 0) & (at >= 0) & (least <= na) & (na < below) & (least <= nb) & (nb < below)
        out[ok] = at[ok] + k * BUCKETS
    return out


def may_pass(a: np.ndarray, b: np.ndarray, threshold: float, total: np.ndarray | None = None) -> np.ndarray:
    """Whether the estimate leaves room for Jaccard >= threshold. Equal
    registers over used ones estimate it; different minima share a register at
    a rate of 1 / (3 * 2^mantissa bits), which is taken off. The used registers
    are a draw without replacement from the union, whose size at the threshold
    follows from ``total``, the sum of both set sizes; a pair is pruned only
    ``SIGMAS`` standard errors of that draw below the threshold. Without
    ``total`` the draw counts as one with replacement, which prunes less."""
    used = (a | b) != 0
    n = np.maximum(used.sum(-1), 1)
    c = ((a == b) & used).sum(-1)
    p = 1 / (3 * (1 << MANTISSA_BITS))
    j = (c / n - p) / (1 - p)
    left = 1.0
    if total is not None:
        union = total / (1 + threshold)
        left = np.maximum(union - n, 0) / np.maximum(union - 1, 1)
    return j >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / n * left) - 0.5 / n


def signatures(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """``id, key, n_shingles, reg`` per row."""
    src = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("key", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("reg", T.BinaryType())])

    def run(batches):
        seen = WordHashes()
        for batch in batches:
            n, reg = [], []
            for t in batch.column("text"):
                s = shingle_set(seen.of(words_of(t.as_py())), words)
                n.append(len(s))
                reg.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(n, pa.int64()),
                                              pa.array(reg, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def band_rows(classes: DataFrame) -> DataFrame:
    """``band, no, key, n`` for every band in use of every class."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bands, nos = zip(*(_bands(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column("reg")))
            at = pa.array(np.repeat(np.arange(len(bands)), [len(x) for x in bands]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(bands)), pa.array(np.concatenate(nos)), batch.column("key").take(at),
                 batch.column("n").take(at)], names=["band", "no", "key", "n"])

    return classes.select("key", "n", "reg").mapInArrow(run, "band long, no int, key binary, n long")


def sized_bands(classes: DataFrame, threshold: float) -> DataFrame:
    """``band, no, key, n, low``: the bands that two sets of like size share.

    Sizes at the threshold differ by a factor of 1 / threshold at most. A set
    enters its size class and the next (``low``), so such a pair meets in the
    larger set's class. Bands with one set are left out before and after.
    """
    rows = band_rows(classes)
    rows = rows.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("g")).filter("g > 1").select("band"), "band")
    own = F.floor(F.log("n") / (math.log(1 / threshold) + 1e-9))
    rows = rows.withColumn("own", own).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.select(F.xxhash64("band", F.col("own") + F.col("up")).alias("band"), "no", "key", "n", (F.col("up") == 1).alias("low"))
    rows = written(rows, "bands", free=True)
    # two lower sets alone meet in their own class
    met = rows.groupBy("band").agg(F.count(F.lit(1)).alias("g"), F.every("low").alias("all")).filter("g > 1 AND NOT all")
    out = written(rows.join(met.select("band", "g"), "band"), "sized", free=True)
    drop(rows)
    return out


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose binary ``key`` is not in ``keys``.

    A key sets one bit of a map of at least sixteen bits a key, up to 16 MB,
    which is broadcast; a row stays if its bit is set, so none of ``keys`` is
    lost and a few others stay.
    """
    bits = min(max(keys.count() * 16, BITMAP), 4096 * BITMAP)
    cell = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    part, bit, bitmap, own = free_name(rows, "part", "bit", "map", "cell")
    maps = (keys.select(cell().alias(own)).groupBy(F.expr(f"{own} div {BITMAP}").alias(part))
            .agg(F.bitmap_construct_agg(F.expr(f"{own} % {BITMAP}")).alias(bitmap)))
    probe = rows.withColumn(own, cell()).join(F.broadcast(maps), F.expr(f"{own} div {BITMAP}") == F.col(part))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({own} % {BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return probe.withColumn(bit, byte).filter(F.expr(f"shiftright({bit}, cast({own} % 8 as int)) & 1 = 1")).select(*rows.columns)


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets reach the threshold.

    A text travels once per hub ``a`` it is paired with; the members of a hub
    are split in groups of about a thousand, each with a copy of the hub's text.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).alias("k"))
    p = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")))
    hubs = p.select("a", "salt").distinct()
    want = (p.select(F.col("b").alias("key"), "a", "salt", F.lit(False).alias("hub"))
            .unionByName(hubs.select(F.col("a").alias("key"), "a", "salt", F.lit(True).alias("hub")))
            .join(reps, "key"))
    want = written(want, "want", free=True)
    src = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    src = among(src, want.select("key").distinct(), "key")  # only texts that are wanted, and few others, are shuffled
    want = want.withColumnsRenamed({"id": "rep", "key": "want"})
    rows = (src.join(want, (F.col("key") == F.col("want")) & F.col("id").eqNullSafe(F.col("rep")))
            .select("a", "salt", "hub", "key", "text"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        seen = WordHashes()
        hub = shingle_set(seen.of(words_of(df.text[df.hub].iloc[0])), words)
        out = []
        for key, t in zip(df.key[~df.hub], df.text[~df.hub]):
            s = shingle_set(seen.of(words_of(t)), words)
            both = len(np.intersect1d(hub, s, assume_unique=True))
            if 100 * both >= percent * (len(hub) + len(s) - both):
                out.append(key)
        return pd.DataFrame({"a": [df.a.iloc[0]] * len(out), "b": out})

    return rows.groupBy("a", "salt").applyInPandas(run, "a binary, b binary").distinct()


def _by_blocks(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of whole blocks: it gets them with the first and end row of each."""
    def run(batches):
        """Rows come sorted by block; whole blocks are handed over together, the last one waits for its rest."""
        def whole(df):
            block = df[BLOCK].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)])).tolist()
            return work(df, list(zip(first, [*first[1:], len(df)])))

        rest = None
        for batch in batches:
            df = batch.to_pandas()
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            last = (df[BLOCK] == df[BLOCK].iloc[-1]).all(axis=1)
            rest = df[last].reset_index(drop=True)
            if not last.all():
                yield whole(df[~last].reset_index(drop=True))
        if rest is not None:
            yield whole(rest)

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, schema)


def _likely(df: pd.DataFrame, comp: np.ndarray, rank: np.ndarray, reg: np.ndarray, at: np.ndarray, threshold: float):
    """Pairs of row numbers (query, member) of one block that differ in component, fit in size and may pass."""
    n, low, is_query, outer = (df[c].to_numpy()[at] for c in ("n", "low", "query", "outer"))
    q, x = np.flatnonzero(is_query), np.flatnonzero(~is_query.astype(bool))
    step = max(1, PAIR_BLOCK * 16 // max(len(x), 1))
    for s in range(0, len(q), step):
        p = q[s: s + step, None]
        fit = (np.minimum(n[p], n[x]) >= threshold * np.maximum(n[p], n[x]) - 1e-6) & (comp[at][p] != comp[at][x])
        fit &= ~(outer[x].astype(bool) & (rank[at][p] > rank[at][x]))  # of two queries the first one asks
        i, j = np.nonzero(fit & ~(low[p] & low[x]).astype(bool))  # two low ones meet in their own class
        i, j = at[q[s + i]], at[x[j]]
        for k in range(0, len(i), PAIR_BLOCK):
            u, v = i[k: k + PAIR_BLOCK], j[k: k + PAIR_BLOCK]
            ok = may_pass(reg[u], reg[v], threshold, df.n.to_numpy()[u] + df.n.to_numpy()[v])
            u, v = u[ok], v[ok]
            here = first_common(reg[u], reg[v]) == df.no.to_numpy()[u]  # the pair's other bands leave it to this one
            if here.any():
                yield u[here], v[here]


def _open_members(bands: DataFrame, comp: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Members of bands that share one with a member of another component and may pass with it.

    Within a band only the members outside its largest component are queries;
    they meet all members in blocks, compared there by their sizes and then by
    their registers, and of the bands a pair shares only the first counts. (A
    first one that is left out has settled it: its two members were tested, or
    it has one component.) A block hands on its members that have such a pair,
    not the pairs, so what leaves it is in proportion to what enters it.
    """
    m = bands.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    per = m.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("size"))
    tot = per.groupBy("band").agg(F.sum("count").alias("g"), F.sum("size").alias("size"), F.max(F.struct("count", "comp", "size")).alias("big"),
                                  F.count(F.lit(1)).alias("k")).filter("k > 1 AND g > 2")
    parts = lambda n, size, block: F.ceil(F.greatest(n / block, size * MEMBER_BLOCK / (block * SET_BLOCK)))
    tot = tot.select("band", parts(F.col("g") - F.col("big.count"), F.col("size") - F.col("big.size"), QUERY_BLOCK).alias("nq"),
                     parts(F.col("g"), F.col("size"), MEMBER_BLOCK).alias("nm"), F.col("big.comp").alias("big"))
    rows = m.join(tot, "band").join(classes.select("key", "reg"), "key").withColumn("outer", F.col("comp") != F.col("big"))
    cut = lambda n: F.pmod(F.xxhash64("key", "band"), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["band", "no", "key", "comp", "n", "low", "outer", "reg"]
    q = rows.filter("outer").select(*cols, cut("nq").alias("qb"), span("nm").alias("mb"), F.lit(True).alias("query"))
    x = rows.select(*cols, cut("nm").alias("mb"), span("nq").alias("qb"), F.lit(False).alias("query"))
    blocks = q.unionByName(x.select(*q.columns))
    schema = blocks.drop("reg").schema

    def work(df, blocks):
        comp, rank = pd.factorize(df.comp)[0], pd.factorize(df.key, sort=True)[0]
        reg = np.frombuffer(b"".join(df.reg), np.uint16).reshape(len(df), BUCKETS)
        keep = np.zeros(len(df), bool)
        for s, e in blocks:
            for u, v in _likely(df, comp, rank, reg, np.arange(s, e), threshold):
                keep[u] = keep[v] = True
        return pa.RecordBatch.from_pandas(df.loc[keep, schema.names], schema=to_arrow_schema(schema), preserve_index=False)

    return _by_blocks(blocks, work, schema)


def _open_links(members: DataFrame, docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links ``a, b`` that join the components which the members' links join.

    The members of a block meet again with their full shingle sets and are
    compared there, so no pair leaves a block but those that joined two
    components: fewer than its members.
    """
    src = docs.select(text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    src = among(src, members.select("key").distinct(), "key").groupBy("key").agg(F.first("text").alias("text"))

    def sets(batches):
        seen = WordHashes()
        for batch in batches:
            found = [shingle_set(seen.of(words_of(t.as_py())), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["key", "set"])

    def work(df, blocks):
        rank, keys = pd.factorize(df.key, sort=True)
        _, at = np.unique(rank, return_index=True)
        every = [np.frombuffer(df.set.iloc[i], U) for i in at]
        reg = np.stack([registers(s) for s in every])[rank]
        comp, found = pd.factorize(df.comp)[0], []
        for s, e in blocks:
            own = comp[s:e]  # a link renames one of its two components, so that they meet no more in this block
            for u, v in _likely(df, comp, rank, reg, np.arange(s, e), percent / 100):
                for i in np.unique(u):
                    j = v[(u == i) & (comp[v] != comp[i])]
                    j = j[_linked(every[rank[i]], [every[k] for k in rank[j]], percent)]
                    for k in j:
                        if comp[k] != comp[i]:
                            found.append((keys[rank[i]], keys[rank[k]]))
                            own[own == comp[k]] = comp[i]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    full = src.mapInArrow(sets, "key binary, set binary")
    return _by_blocks(members.join(full, "key"), work, "a binary, b binary").distinct()


def _linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``others`` reach the threshold with ``a`` (sorted sets, none empty)."""
    if not others:
        return np.zeros(0, bool)
    n = np.array([len(x) for x in others])
    x = np.concatenate(others)
    hit = a[np.minimum(np.searchsorted(a, x), len(a) - 1)] == x
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
    return 100 * both >= percent * (len(a) + n - both)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, first`` per row of docs.

    Texts link when 100 * |A & B| >= percent * |A | B| over their sets of
    ``words``-word shingles. ``component_id`` is the smallest doc_id reachable
    by links (the row's own if none). Null or empty texts link with nothing.
    Rows with equal texts are one class, so copies are never paired with each
    other. In a component, null ids count after all others; a component with
    null ids only has a null id, and its rows are kept. Extra columns are ignored.
    ``first`` marks a component's first id and text in the order of id (nulls
    last) and text key; rows that repeat both are all marked, and so is every
    row without words.

    Sets meet in bands of their size class. First every member of a band is
    tested against the band's hub (linear in the members), the member whose
    bands hold the most members in all: in a group of altered copies that is
    the text they were made from. What then still lies in different components
    of a band is tested against that band's other members of like size, block
    by block: by registers, then by full sets, and a block hands on only links
    that join components. No cap.
    """
    threshold = percent / 100
    sigs = written(signatures(docs, words, doc_id, text), "signatures", free=True)
    some = sigs.filter("n_shingles > 0")
    classes = written(some.groupBy("key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("reg").alias("reg")),
                      "classes", free=True)
    reps = classes.select("key", "id")
    rows = sized_bands(classes, threshold)
    reach = rows.groupBy("key").agg(F.sum("g").alias("w"))
    hubs = rows.join(reach, "key").groupBy("band").agg(F.max(F.struct("w", "key", "n")).alias("hub"))
    like = 100 * F.least("hub.n", "n") >= percent * F.greatest("hub.n", "n")
    tested = (rows.join(hubs, "band").filter((F.col("key") != F.col("hub.key")) & like)
              .select(F.col("hub.key").alias("a"), F.col("key").alias("b"), (F.col("hub.n") + F.col("n")).alias("total")).distinct())
    tested = written(tested, "tested", free=True)
    regs = classes.select(F.col("key").alias("k"), "reg")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS) for c in ("ra", "rb"))
            ok = pa.array(may_pass(x, y, threshold, batch.column("total").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    star = (tested.join(regs, F.col("a") == F.col("k")).select("a", "b", "total", F.col("reg").alias("ra"))
            .join(regs, F.col("b") == F.col("k")).select("a", "b", "total", "ra", F.col("reg").alias("rb"))
            .mapInArrow(run, "a binary, b binary"))
    star = written(star, "star", free=True)
    edges = written(verify(star, docs, reps, words, percent, doc_id, text), "links", free=True)
    comp = components(edges).withColumnRenamed("node", "key")
    more = written(_open_members(rows, comp, classes, threshold), "open", free=True)
    drop(rows, tested, star)
    if not more.isEmpty():
        edges = edges.unionByName(written(_open_links(more, docs, words, percent, doc_id, text), "links", free=True))
        comp = components(edges).withColumnRenamed("node", "key")
    drop(more)
    named = classes.select("key", "id").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"))
    by_key = named.join(least, "comp").select("key", F.col("least.id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("lead"))
    out = sigs.select("id", "key", "n_shingles").join(by_key, "key", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles",
                     F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                     F.col("key").alias("text_key"), "lead")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key",
                      ((F.col("n_shingles") == 0) | (F.col("lead") & kept)).alias("first"))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, all columns unchanged:
    the one with the smallest id (nulls last), of repeated ids the one with
    the smallest text key, of rows that repeat both any one. Rows without words
    link with nothing and stay, but repeat an id and text as others do; with a
    null id all stay."""
    near = written(near_duplicates(docs, words, percent, doc_id, text), "near", free=True)
    key, rid, k2 = free_name(docs, "key", "rid", "key2")
    pair = [F.col("doc_id").alias(rid), F.col("text_key").alias(k2)]
    gone = near.filter(~F.col("first")).select(*pair).distinct()
    keyed = docs.withColumn(key, text_key(F.col(text)))

    def same(rows: DataFrame):
        return (F.col(key) == F.col(k2)) & F.col(rid).eqNullSafe(rows[doc_id])

    rest = keyed.join(gone, same(keyed), "left_anti")
    again = near.filter("first AND (n_shingles > 0 OR doc_id IS NOT NULL)").groupBy(*pair).count().filter("count > 1").drop("count")
    if again.isEmpty():  # no row repeats an id and its text
        return rest.select(*docs.columns)
    once = rest.join(again, same(rest), "left_anti")
    twice = rest.join(again, same(rest), "left_semi").dropDuplicates([doc_id, key])
    return once.unionByName(twice).select(*docs.columns)


@register("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark, sf_dir):
    """Near duplicates of all documents on 4-word shingles at Jaccard 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("text_key", "first")
