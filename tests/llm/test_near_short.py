"""Near-dedup of short texts: every pair of few shingles must meet in a band."""

import random

import numpy as np

from hotzone.llm import near_dedup as ND
from tests.llm import brute as B


def test_every_short_set_has_a_band_for_its_pairs():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 8, 20, 40, 63, 64, 70, 90):
        for _ in range(2000 if n < 10 else 500):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            more = rng.integers(0, 2**64, n // 4, dtype=np.uint64)  # J = 0.8 or a little above
            b = np.unique(np.concatenate([a, more]))
            x, y = ND.band_hashes(ND.registers(a)), ND.band_hashes(ND.registers(b))
            assert len(np.intersect1d(x, y)), n


def test_short_texts_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    texts = ["Hello World", "hello  world", "thank you", "Thank You", "home", "HOME "]
    for k in range(300):
        t = [word() for _ in range(1 + k % 12)]
        texts += [" ".join(t), "  ".join(t).title(), " ".join(t[:-1])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_duplicates(df, words).collect()}
        assert got == B.near_dedup(rows, words)
    assert got[1][1] == got[0][1] == 0 and got[3][1] == 2 and got[5][1] == 4
