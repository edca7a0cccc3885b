"""Near-dedup of a large group whose pairs lie just below the threshold: rows made, and the links in it."""

import numpy as np

from hotzone.llm import near_dedup as ND

from . import brute as B


def near_group(n):
    """Copies of one text of 80 words that differ from it in a word of their own: pairs changed at one place
    link (0.88), others do not (0.77). The text itself is not among them."""
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(80)]
    out = []
    for d in range(n):
        at = 5 * int(rng.integers(1, 15))
        out.append((d, " ".join([*base[:at], f"own{d}", *base[at + 1:]])))
    return out


def test_rows_made_by_a_group_just_below_the_threshold(spark, monkeypatch):
    rows, made = near_group(500), {}
    plain = ND.written

    def written(df, name, free=False):
        out = plain(df, name, free)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ND, "written", written)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ND.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == B.near_dedup(rows)
    assert 10 < len({c for _, c in got.values()}) < 20
    # about 115 000 pairs do not link and may pass: members leave their blocks, once a band at most, pairs do not
    assert max(made.values()) < 2 * 500 * 21 and made["links"] < 500 * 21


def test_linked_equals_sets():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 60, 50).astype(np.uint64))
    others = [np.unique(rng.integers(0, 60, k).astype(np.uint64)) for k in (1, 20, 90, 200, 300)] + [a]
    want = [100 * len(set(a) & set(x)) >= 80 * len(set(a) | set(x)) for x in others]
    assert ND._linked(a, others, 80).tolist() == want and len(ND._linked(a, [], 80)) == 0


def test_blocks_by_shingles_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ND, "SET_BLOCK", 1 << 11)
    rows = near_group(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ND.near_duplicates(df).collect()} == B.near_dedup(rows)
