"""Toxicity and near-dedup: rows made and shuffled stay in proportion to the input."""

import numpy as np
from pyspark.sql import functions as F

from hotzone.llm import near_dedup as ND
from hotzone.llm import toxicity as TX
from hotzone.llm.decontaminate import words_of

STEMS = (5, 6, 8)


def test_doc_counts_equal_exploded_tokens(spark):
    rng = np.random.default_rng(3)
    vocab = ["Idiot", "idiotic", "häßlichkeit", "Ärger", "naïvely", "x1", "abcdefgh", "abcdefghi", "don't", "日本語日本語", "ok"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 9))) for _ in range(300)] + [None, "", "..."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    every = docs.select(F.explode(TX.doc_tokens(F.col("text"), STEMS)).alias("tok")).groupBy("tok").count().collect()
    want = {r["tok"]: r["count"] for r in every if len(r["tok"]) % 2}
    got = TX.doc_counts(docs, [*want, "=never"], STEMS, "text")
    assert {r["tok"]: r["n"] for r in got.collect()} == want
    # a task hands on a row per token, however many documents hold it
    many = TX.doc_counts(docs.filter("text != ''").crossJoin(spark.range(20)).coalesce(2), ["=ok"], STEMS, "text")
    assert many.count() == 1 and "Generate" not in many._jdf.queryExecution().executedPlan().toString()
    assert docs.select(words_of(F.col("text")).alias("w")).count() == 303


def test_first_common_band():
    rng = np.random.default_rng(4)
    a, b = [], []
    for n in (1, 3, 10, 14, 17, 40, 70, 90, 95, 400, 2000):
        for share in (0.3, 0.8, 0.97, 1.0):
            s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            t = np.unique(np.concatenate([s[rng.random(len(s)) < share], rng.integers(0, 2**64, 1 + n // 20, dtype=np.uint64)]))
            a.append(ND.registers(s))
            b.append(ND.registers(t))
    got = ND.first_common(np.array(a), np.array(b))
    for x, y, at in zip(a, b, got):
        p, q = (dict(zip(*(v.tolist() for v in ND._bands(r)))) for r in (x, y))
        assert at == min((no for key, no in p.items() if q.get(key) == no), default=-1)
    assert (got >= 0).sum() > 10 and (got < 0).any()


def test_among_keeps_every_wanted_key_and_few_others(spark):
    rows = spark.range(200_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), "id")
    for n in (0, 1, 3000):
        keys = rows.filter(F.col("id") < n).select("key")
        got = ND.among(rows, keys, "key")
        assert got.columns == rows.columns
        ids = {r["id"] for r in got.select("id").collect()}
        assert ids >= set(range(n)) and len(ids) - n < 0.1 * 200_000
