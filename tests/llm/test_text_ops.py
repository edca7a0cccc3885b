"""Text operators against brute force, on the small tables and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from hotzone.llm import chat_format as CH
from hotzone.llm import near_dedup as ND
from hotzone.llm.decontaminate import decontaminate
from hotzone.llm.licence_scan import scan_licences
from hotzone.llm.line_dedup import dedup_lines
from hotzone.llm.substring_dedup import dedup_substrings
from tests.llm import brute as B

SCHEMA = "doc_id long, text string, key string, n_words long, rank int, hit string"


def awkward(seed=5):
    """Nulls, empty and long texts, ties, repeated rows, shared and near-equal passages."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["École", "straße", "ÉCOLE", "x\x0by", "a b", "İx", "Σας"]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared, line = words(60), "Same   Line here"
    texts = [None, "", " \t\n", "one", "Two WORDS", "\n\n", "one", "ONE"]
    for i in range(60):
        w = words(rnd.choice([3, 20, 80, 200]))
        if i % 4 == 0:
            w[len(w) // 2:len(w) // 2] = shared[rnd.randint(0, 10):rnd.randint(40, 60)]
        t = " ".join(w)
        if i % 3 == 0:
            t = t + "\n" + (" " * (i % 5)) + (line if i % 2 else line.upper()) + "\r\n" + " ".join(words(5))
        texts.append(t)
    base = words(300)
    for k in range(12):  # near copies, each with a few words changed
        w = list(base)
        for _ in range(k):
            w[rnd.randrange(len(w))] = f"new{rnd.random()}"
        texts.append(" ".join(w))
    texts += [texts[20]] * 15 + [" ".join(words(20_000)), " ".join(["again"] * 500)]
    return [(i, t, "k", i, 1, "h") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def bench_rows(rows):
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    w = long[0].split()
    return [(1, " ".join(w[5:40])), (2, " ".join(w[8:18]).upper()), (3, "two words"), (10, None), (11, ""), (12, "absent thing"),
            (None, " ".join(long[3].split()[:12])), (2, " ".join(w[8:18]))]


def test_decontaminate(spark, docs, rows):
    bench = bench_rows(rows)
    bdf = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(B.decontaminate(pairs(rows), bench))
    for kw in ({}, {"broadcast_windows": 3}):
        got = decontaminate(docs, bdf, **kw)
        assert set(got.columns) >= {"key", "rank", "hit"} and got.columns.count("n_words") == 1
        got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect())) == want
    clean = decontaminate(docs, bdf, mode="documents")
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    cut = decontaminate(docs, bdf, mode="spans")
    assert cut.count() == len(rows)
    again = decontaminate(cut.select("doc_id", "text"), spark.createDataFrame([(1, " ".join(bench[0][1].split()[:10]))], "item_id long, text string"))
    left = {r.doc_id: r.n_words for r in again.collect()}
    assert all(left[w[0]] == w[1] - w[2] for w in want)
    assert not again.filter("contaminated").count()


def test_decontaminate_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).filter("contaminated").count() == 0
    assert decontaminate(docs.limit(0), none).count() == 0


def test_line_dedup(docs, rows):
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = got.select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted(map(tuple, got.collect())) == sorted(B.line_dedup(pairs(rows)))
    assert dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a\nb")] * 6 + [(1, "A \nc")] * 4, "doc_id long, text string")
    got = sorted((r.text, r.n_dropped) for r in dedup_lines(df).collect())
    assert got == [("b", 1)] * 6 + [("c", 1)] * 4


def test_substring_dedup(docs, rows):
    got = dedup_substrings(docs)
    assert got.select("key", "rank", "hit").distinct().count() == 1
    got = got.select("doc_id", "n_words", "n_removed", "text")
    assert sorted(map(tuple, got.collect())) == sorted(B.substring_dedup(pairs(rows)))
    assert dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [1, 4, 50])
def test_substring_dedup_other_lengths(docs, rows, threshold):
    got = dedup_substrings(docs, threshold).select("doc_id", "n_words", "n_removed", "text")
    assert sorted(map(tuple, got.collect())) == sorted(B.substring_dedup(pairs(rows), threshold))


def test_substring_dedup_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, t), (None, t), (3, "x " + t + " y"), (3, "other words")], "doc_id long, text string")
    got = sorted((r.text, r.n_removed) for r in dedup_substrings(df).collect())
    assert got == [("", 50), ("", 50), ("other words", 0), ("x y", 50)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_dedup(docs, rows, words):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_duplicates(docs, words).collect()}
    assert got == B.near_dedup(pairs(rows), words)


def test_near_dedup_keeps_one_of_each_group(spark, docs, rows):
    want = B.near_dedup(pairs(rows))
    kept = ND.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    t = " ".join(f"w{i}" for i in range(30))
    odd = spark.createDataFrame([(5, t), (5, t), (9, t + " z"), (None, t), (None, ""), (7, None), (7, None), (8, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in ND.dedup(odd).collect()) == sorted(
        [("5", t), ("None", ""), ("7", None), ("8", "a b")], key=str)
    assert ND.dedup(docs.limit(0)).count() == 0


def test_near_dedup_group_where_the_hub_links_to_few(spark):
    """A ring of texts, each near the next only: one component, found through members that the hub does not reach."""
    n, step, size = 40, 12, 200
    w = [f"w{i}" for i in range(n * step + size)]
    rows = [(i, " ".join(w[i * step:i * step + size])) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_duplicates(df).collect()}
    assert got == B.near_dedup(rows) and {c for _, c in got.values()} == {0}


def test_registers_estimate(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 800):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        ra = ND.registers(a)
        assert ND.may_pass(ra, ra, 0.8)
        assert not ND.may_pass(ND.registers(np.unique(rng.integers(0, 2**64, 800, dtype=np.uint64))), ND.registers(np.unique(rng.integers(0, 2**64, 800, dtype=np.uint64))), 0.8)
    assert not ND.registers(np.zeros(0, np.uint64)).any()


ROLES = [("system", "be kind"), ("user", "hi"), ("assistant", "</s>[INST] ok [/INST] &lt; &amp;"), ("user", "<<SYS>>"), ("assistant", "")]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(ROLES)]
    rows += [(2, 0, "assistant", "starts wrongly"), (2, 1, "tool [INST]", "<|text|>x"), (2, 1, None, None)]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <s>") for i in range(300)]
    rows += [(None, 5, "user", "no id"), (4, None, "user", "no turn"), (4, -70, "assistant", "early")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    got = {r.conv_id: r for r in CH.format_chats(df).withColumn("back", CH.read_turns(F.col("formatted"))).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for c in (1, 2, 3, 4, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert [(x.role, x.text) for x in got[c].back] == want
        assert got[c].formatted == "".join(s.text for s in got[c].segments) and got[c].n_turns == len(want)
        loss = [s.text for s in got[c].segments if s.loss]
        assert len(loss) == sum(r == "assistant" for r, _ in want)
        for s in loss:
            assert not any(m in s for m in CH.LLAMA.controls())
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: True, 4: True, None: False}
    assert CH.format_chats(df.limit(0)).count() == 0


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (3, apache), (4, "text\n" + apache.upper() + "\nmore text here"), (5, "Released under the MIT License.\n" + apache),
            (6, "licensed under nothing at all"), (6, apache), (None, "word"),
            (7, "Permission to use, copy, modify, and/or distribute this software for any purpose with\nor without fee is hereby granted, "
                "provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nother words")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, dice string")
    got = sorted(((str(r.doc_id), r.licence, r.licences, r.n_matched) for r in scan_licences(df).collect()), key=str)
    assert got == sorted([("1", None, "", 0), ("2", None, "", 0), ("3", "Apache-2.0", "Apache-2.0", 1), ("4", "Apache-2.0", "Apache-2.0", 1),
                          ("5", "Apache-2.0", "Apache-2.0,MIT", 2), ("6", None, "", 0), ("6", "Apache-2.0", "Apache-2.0", 1),
                          ("None", None, "", 0), ("7", "ISC", "ISC", 1)], key=str)
    assert scan_licences(df.limit(0)).count() == 0
