"""Operator 5: substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``threshold`` consecutive words at least
one anchor is chosen, by their content alone, so equal passages of that length
share an anchor at the same place. Documents are joined on anchors that occur
more than once; around them matches are extended to both sides by hashing
every ``threshold``-word window that chose the anchor. Windows that occur more
than once merge to maximal repeats, and the words these cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import drop, free_name, register, ship, table, text_key, written
from hotzone.llm.shingles import Rolling, WordHashes

ship(__name__)

U = np.uint64
SEED_WORDS = 10
SEED, WINDOW, CHECK = Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642F), Rolling(0xE7037ED1A0B428DB)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return text.encode().split() if text else []


def anchors_of(h: np.ndarray, threshold: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place of the anchor that each ``threshold``-word window
    chooses: the smallest seed hash in it, the first one of equal ones."""
    g = SEED.of(h, seed)
    w = threshold - seed + 1
    if len(g) < w:
        return g[:0], np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(g, w)
    at = np.arange(len(v)) + v.argmin(axis=1)
    return g[at], at


def anchor_rows(docs: DataFrame, threshold: int, seed: int) -> DataFrame:
    """``id, key, n_words, anchors`` per row: the hashes of its anchors, one that
    it holds more than once given twice."""
    def run(batches):
        seen = WordHashes()
        for batch in batches:
            n, out = [], []
            for t in batch.column("text"):
                h = seen.of(words_of(t.as_py()))
                g, at = anchors_of(h, threshold, seed)
                if len(at):
                    first = np.concatenate([[True], at[1:] != at[:-1]])
                    u, c = np.unique(g[first], return_counts=True)
                    g = np.concatenate([u, u[c > 1]])
                n.append(len(h))
                out.append(g.view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))],
                names=["id", "key", "n_words", "anchors"])

    schema = T.StructType([docs.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("n_words", T.LongType()),
                           T.StructField("anchors", T.ArrayType(T.LongType()))])
    return docs.select("id", "key", "text").mapInArrow(run, schema)


def window_rows(found: DataFrame, threshold: int, seed: int) -> DataFrame:
    """``rid, pos, w1, w2`` for every window whose anchor is among the text's shared ones."""
    def table_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["rid", "pos", "w1", "w2"])

    def run(batches):
        seen = WordHashes()
        for batch in batches:
            parts, n = [], 0
            rid = batch.column("rid").to_numpy()
            for i, t in enumerate(batch.column("text")):
                h = seen.of(words_of(t.as_py()))
                g, _ = anchors_of(h, threshold, seed)
                shared = batch.column("shared")[i].values.to_numpy().view(U)
                pos = np.flatnonzero(np.isin(g, shared))
                parts.append((np.full(len(pos), rid[i]), pos.astype(np.int32), WINDOW.of(h, threshold)[pos].view(np.int64),
                              (CHECK.of(h, threshold)[pos] >> U(32)).astype(np.uint32).view(np.int32)))
                n += len(pos)
                if n > 300_000:
                    yield table_of(parts)
                    parts, n = [], 0
            if parts:
                yield table_of(parts)

    return found.mapInArrow(run, "rid long, pos int, w1 long, w2 int")


def kept_words(words: list[bytes], starts: np.ndarray, threshold: int) -> list[bytes]:
    """``words`` without those covered by a window that starts in ``starts``."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + threshold, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered) if not c]


def repeats(docs: DataFrame, threshold: int = 35, doc_id: str = "doc_id", text: str = "text",
            seed: int = SEED_WORDS) -> DataFrame:
    """``key, n_words, copies, starts`` per distinct text that has words to
    lose: where its repeated windows start. ``copies`` > 1 tells that the text
    itself occurs so often; then all its windows are repeated and ``starts`` is
    null.
    """
    seed = min(seed, threshold)
    src = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    anchors = written(anchor_rows(src, threshold, seed).withColumn("rid", F.monotonically_increasing_id()), "anchors", free=True)
    base = anchors.filter(F.col("n_words") >= threshold)
    # one row stands for all copies of a text
    texts = base.groupBy("key").agg(F.min(F.struct("id", "rid")).alias("rep"), F.max("n_words").alias("n_words"),
                                    F.count(F.lit(1)).alias("copies"))
    texts = written(texts.select("key", "rep.id", "rep.rid", "n_words", "copies"), "texts", free=True)
    each = base.join(texts.select("rid"), "rid", "left_semi").select("rid", F.explode("anchors").alias("a"))
    shared = each.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    mine = (each.join(shared, "a").groupBy("rid").agg(F.collect_set("a").alias("shared"))
            .join(texts.select("rid", "key", F.col("id").alias("rep")), "rid"))
    mine = written(mine, "shared", free=True)
    drop(anchors)
    one = src.join(mine, (src["key"] == mine["key"]) & F.col("id").eqNullSafe(F.col("rep"))).select("rid", "text", "shared")
    found = written(window_rows(one, threshold, seed), "windows", free=True)
    drop(mine)
    place = F.xxhash64("rid", "pos")  # equal for a repeated row's places, which count once
    twice = (found.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
             .filter("lo != hi").select("w1", "w2"))
    twice = written(twice, "twice", free=True)
    starts = found.join(twice, ["w1", "w2"], "left_semi").groupBy("rid").agg(F.collect_set("pos").alias("starts"))
    starts = written(starts, "starts", free=True)
    drop(found, twice)
    out = texts.join(starts, "rid", "left").filter("copies > 1 OR starts IS NOT NULL")
    return out.select("key", "n_words", "copies", F.when(F.col("copies") == 1, F.col("starts")).alias("starts"))


def dedup_substrings(docs: DataFrame, threshold: int = 35, doc_id: str = "doc_id", text: str = "text",
                     out_text: str | None = None, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` plus the number of words, of words removed and the kept text
    (kept words joined by one space) in ``out_text`` (default: ``text`` itself).

    A word goes if a window of ``threshold`` consecutive words of its document
    covers it whose word sequence also starts anywhere else, in the same or
    another document (a repeated row is another document). Null texts have no
    words and give ''. Texts shorter than the window keep all. Columns of docs
    with the new names are replaced; others pass through.
    """
    out_text = out_text or text
    key, hit = free_name(docs, "key", "hit")
    gone = repeats(docs, threshold, doc_id, text).select(F.col("key").alias(key), F.struct("copies", "starts").alias(hit))
    keep = [c for c in docs.columns if c not in (n_words, n_removed)]
    joined = docs.select(*keep).withColumn(key, text_key(F.col(text))).join(gone, key, "left")
    cols = [c for c in keep if c != out_text]
    fields = [docs.schema[c] for c in cols]
    schema = T.StructType(fields + [T.StructField(out_text, T.StringType()), T.StructField(n_words, T.LongType()),
                                    T.StructField(n_removed, T.LongType())])

    def run(batches):
        for batch in batches:
            new, n, cut = [], [], []
            for t, h in zip(batch.column(text), batch.column(hit)):
                words, h = words_of(t.as_py()), h.as_py()
                left = words
                if h and h["copies"] > 1:
                    left = []
                elif h:
                    left = kept_words(words, np.array(h["starts"]), threshold)
                new.append(b" ".join(left).decode())
                n.append(len(words))
                cut.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in cols], pa.array(new, pa.string()), pa.array(n, pa.int64()), pa.array(cut, pa.int64())],
                names=schema.names)

    names = dict.fromkeys([*cols, text, hit])
    return joined.select(*names).mapInArrow(run, schema)


@register("op5_substring_dedup")
def op5_substring_dedup(spark, sf_dir):
    """Passages of 35 words or more that occur twice, cut from all documents."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
