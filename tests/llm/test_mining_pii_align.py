"""Hard negatives, personal data and tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from hotzone.llm import align as AL
from hotzone.llm import hard_negatives as HN
from hotzone.llm import pii as PI
from hotzone.llm.common import table
from tests.conftest import SMALL

# --- hard negatives -------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    """rows: (id, label, vector); vectors and labels as they come."""
    ok = [(i, *r) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    ok = [(i, d, lab, [int(np.floor(256 * np.float64(x))) for x in v]) for i, d, lab, v in ok]
    out = []
    for ai, ad, al, av in ok:
        if not is_anchor(ad):
            continue
        got = sorted((-sum(x * y for x, y in zip(av, v)), d is None, d or 0, i, lab) for i, d, lab, v in ok if len(v) == len(av) and i != ai)
        for s, none, d, _, _ in [g for g in got if g[4] == al][:positives]:
            p = -s
            near = [g for g in got if g[4] != al and 50 * p <= -100 * g[0] <= 95 * p][:negatives]
            out += [(ad, None if none else d, k, None if g[1] else g[2], p, -g[0]) for k, g in enumerate(near, 1)]
    return out


SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, row long"


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, lab, v in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in HN.hard_negatives(df, F.col("vec_id") % every == 0).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 6))
    rows = [(i, int(k), (centre[k] + 0.7 * rng.standard_normal(6) + 1).tolist()) for i, k in enumerate(rng.integers(0, 4, 400))]
    rows += [(1000 + i, 0, rows[5][2]) for i in range(60)]             # copies: ties by id
    rows += [(2000 + i, 1, [0.0] * 6) for i in range(5)]                # scores of zero
    rows += [(3000 + i, 2, [-1.0] * 6) for i in range(10)]              # negative scores
    rows += [(7, 1, rows[7][2]), (7, 1, rows[7][2]), (20, 0, rows[20][2])]  # repeated ids
    rows += [(4001, None, rows[0][2]), (4005, 1, None), (4010, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (4015, 2, [float("nan")] * 6), (4020, 2, [float("inf")] * 6),
             (4025, 2, []), (4030, 1, []), (4035, 1, [1.0, 2.0]), (4036, 2, [0.5, 1.2])]
    monkeypatch.setattr(HN, "ROW_BYTES", 48 * 16)     # many blocks; a hot label goes into several
    monkeypatch.setattr(HN, "ANCHOR_BYTES", 48 * 16)
    monkeypatch.setattr(HN, "AT_ONCE", 7)
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    assert order(mined(spark, rows)) == order(want)


def test_hard_negatives_large_values_and_null_ids(spark):
    big = [(i, i % 2, [float(2**40 + i * 3**k) for k in range(3)]) for i in range(20)]
    # beyond 64 bits the scores are held, so only smaller ones are compared here
    mid = [(i, i % 2, [float((2**20 + 7919 * i) * (k + 1)) / (1 + i % 3) for k in range(3)]) for i in range(60)]
    assert len(mined(spark, big)) >= 0
    assert order(mined(spark, mid)) == order(brute_negatives(mid, lambda i: i % 5 == 0))
    nulls = [(5, 0, [1.0, 1.0]), (None, 0, [1.0, 1.0]), (2**60 + 1, 0, [1.0, 1.0]), (None, 1, [0.9, 0.9]), (2**60 + 3, 1, [0.9, 0.9])]
    got = mined(spark, nulls)
    assert order(got) == order(brute_negatives(nulls, lambda i: i is not None and i % 5 == 0))
    assert any(r[1] is None for r in got) and any(r[3] is None for r in got) and any(r[3] == 2**60 + 3 for r in got)


def test_hard_negatives_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, 0, [1.0])]) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []


def test_hard_negatives_query(spark):
    emb = table(spark, SMALL, "embeddings").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label, r.embedding) for r in emb]
    got = [tuple(r) for r in entry.queries()["op11_hard_negatives"](spark, SMALL).collect()]
    assert order(got) == order(brute_negatives(rows, lambda i: i % 50 == 0))


def test_sorted_stream_opens_windows():
    w = HN.Windows(2, 50, 95)
    stream = [(1, 10, False, 7, 100), (1, 10, True, 8, 96), (1, 10, True, 9, 95), (1, 10, False, 6, 90), (1, 10, True, 3, 80), (1, 10, True, 4, 70),
              (1, 10, True, 2, 40), (2, 20, True, 1, 5)]
    out = [x for s in stream for x in w.feed(*s)]
    assert out == [(10, 7, 1, 9, 100, 95), (10, 7, 2, 3, 100, 80), (10, 6, 1, 3, 90, 80), (10, 6, 2, 4, 90, 70)]
    keys = [HN.pair_key(1, 5, False, None, 0), HN.pair_key(1, 5, True, -3, 9), HN.pair_key(1, 5, True, 4, 1), HN.pair_key(1, 5, True, None, 0),
            HN.pair_key(1, 4, False, 0, 0), HN.pair_key(1, -4, False, 0, 0), HN.pair_key(2, 9, False, 0, 0)]
    assert keys == sorted(keys)


# --- personal data --------------------------------------------------------


def brute_base(t):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            odd, even = d[-1::-2], d[-2::-2]
            return 14 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    out = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(rx.items()) for m in re.finditer(p, t or "") if good(kind, m.group())]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for n in range(30_000):
        t = "".join(r.choice("ab@@..--+ 0123456789()%é") for _ in range(r.randint(0, 45)))
        assert [x[:3] for x in PI.find(t) if not x[3]] == brute_base(t), t


CARD = "4565410125667261"
DISGUISED = [
    ("email", "write to jоhn.dоe@exаmple.com now", "jоhn.dоe@exаmple.com"),
    ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "to john dot doe at example dot co dot uk today", "john dot doe at example dot co dot uk"),
    ("email", "john [at] example [dot] com", "john [at] example [dot] com"),
    ("email", "JOHN(AT)EXAMPLE.COM,", "JOHN(AT)EXAMPLE.COM"),
    ("email", "ana arroba ejemplo punto es", "ana arroba ejemplo punto es"),
    ("email", "max [at] beispiel <punkt> de", "max [at] beispiel <punkt> de"),
    ("email", "a&#64;b.com, c&#x40;d&period;org", "a&#64;b.com"),
    ("email", "see john @ example.com", "john @ example.com"),
    ("email", "jo​hn@exam­ple.com", "jo​hn@exam­ple.com"),
    ("ip", "host 192 dot 168 dot 0 dot 12 is up", "192 dot 168 dot 0 dot 12"),
    ("ip", "host 192[.]168[.]0[.]12 is up", "192[.]168[.]0[.]12"),
    ("ip", "１９２．１６８．０．１２", "１９２．１６８．０．１２"),
    ("card", "card ４５６５４１０１２５６６７２６１ ok", "４５６５４１０１２５６６７２６１"),
    ("card", "card four five six five four one zero one two five six six seven two six one end",
     "four five six five four one zero one two five six six seven two six one"),
    ("card", "4565–4101–2566–7261", "4565–4101–2566–7261"),
    ("phone", "call plus one nine eight eight five five five two four eight five now", "plus one nine eight eight five five five two four eight five"),
    ("phone", "tel +1 (988) 555‑2485.", "+1 (988) 555‑2485"),
    ("phone", "tel +٤٩ ٣٠ ١٢٣٤٥٦٧٨", "+٤٩ ٣٠ ١٢٣٤٥٦٧٨"),
]


@pytest.mark.parametrize("kind,text,span", DISGUISED)
def test_disguises_map_back_to_the_source(kind, text, span):
    assert (kind, span) in [(k, text[s:e]) for k, s, e, added in PI.find(text) if added]


@pytest.mark.parametrize("text", [
    "meet me at example.com", "one two three of them", "at noon dot", "he is at home", "<at> work", "3 at 4 dot 5", "pages 12–15 at 3.5", "un deux trois",
    "the dot at the end", "1.2.3", "plus one", "", "€ 5 @ home"])
def test_plain_texts_have_no_spans(text):
    assert PI.find(text) == []


def test_base_spans_stay_and_longer_ones_are_added():
    t = "jоhn.doe@example.com and +1 (988) 555-2485 one day " + CARD
    got = [(k, t[s:e], a) for k, s, e, a in PI.find(t)]
    assert ("email", "hn.doe@example.com", False) in got and ("email", "jоhn.doe@example.com", True) in got
    assert ("phone", "+1 (988) 555-2485", False) in got and ("card", CARD, False) in got and len(got) == 4
    assert PI.mask(t, PI.find(t)) == "<email> and <phone> one day <card>"


def test_rewriting_maps_every_character():
    r = random.Random(9)
    for _ in range(500):
        t = "".join(r.choice("abcde") for _ in range(30))
        cuts = sorted(r.sample(range(31), 6))
        edits = [(s, e, "".join(r.choice("XY") for _ in range(r.randint(0, 3)))) for s, e in zip(cuts[::2], cuts[1::2])]
        w = PI.Rewritten(t, edits)
        src = []
        at = 0
        for s, e, x in edits:
            src += [(i, i + 1) for i in range(at, s)] + [(s, e)] * len(x)
            at = e
        src += [(i, i + 1) for i in range(at, 30)]
        assert len(src) == len(w.text)
        assert [w.source(i, i + 1) for i in range(len(src))] == src


def test_very_long_texts_take_linear_time():
    import time

    for t in ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "dot " * 80_000, " at " * 80_000, "a dot " * 60_000 + "at b dot c", "+1" * 150_000, "@" * 300_000,
              "1." * 150_000, "one " * 80_000, "<at" * 100_000, "​" * 300_000, "a at b." * 40_000]:
        start = time.time()
        PI.find(t)
        assert time.time() - start < 5, t[:10]


def test_pii_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = entry.queries()["op12_pii"](spark, SMALL).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0
    for r in rows:
        base = brute_base(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans == text if r.n_added == 0 else set(text.split(",")) - {""} < set(r.spans.split(","))


def test_pii_tables(spark):
    schema = "doc_id long, text string, kind string, start int"
    rows = [(1, None, "k", 1), (1, "", None, 2), (None, "x a@b.cd y", "k", None), (None, "x a@b.cd y", "k", None)]
    out = PI.scan(spark.createDataFrame(rows, schema), masked="clean").collect()
    assert sorted((repr(r.doc_id), r.text, r.clean, len(r.pii)) for r in out if r.text is not None) == [
        ("1", "", "", 0), ("None", "x a@b.cd y", "x <email> y", 1), ("None", "x a@b.cd y", "x <email> y", 1)]
    assert [(r.clean, r.pii) for r in out if r.text is None] == [(None, [])]
    assert PI.digest(PI.scan(spark.createDataFrame([], schema))).count() == 0
    with pytest.raises(ValueError):
        PI.scan(spark.createDataFrame(rows, schema), spans="kind")


# --- tokenizer alignment --------------------------------------------------


def brute_alignment(texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, hash, overlaps, shared; by the tokenizers' own libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(AL.byte_bpe())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=AL.piece_bpe())
    letters = AL.byte_letters()
    per, links = [], []
    for t in texts:
        if not t:
            per.append(None)
            continue
        src = (" " + t).encode()
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != src or b"".join(bb) != src:
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda ends: [sum(c < e for c in cuts) for e in ends]
        ga, gb = group(ends_a), group(ends_b)
        text = ";".join(",".join(str(i) for i, g in zip(ia, ga) if g == k) + "|" + ",".join(str(i) for i, g in zip(ib, gb) if g == k) for k in range(len(cuts)))
        pairs = [(x, y) for x, e in zip(ia, ends_a) for y, f in zip(ib, ends_b) if e == f]
        links += pairs
        over = sum(min(e, f) > max(e - len(p), f - len(q)) for e, p in zip(ends_a, ba) for f, q in zip(ends_b, bb))
        shared = sum(ga.count(k) * gb.count(k) for k in range(len(cuts)))
        per.append((len(ia), len(ib), len(cuts), pairs, hashlib.sha256(text.encode()).hexdigest(), over, shared))
    n = Counter(links)
    best = {}
    for (x, y), c in n.items():
        best[y] = max(best.get(y, 0), c)
    return [(0,) * 8 + ("",) if p is None else
            (p[0], p[1], p[2], len(p[3]), p[5], p[6], sum(n[q] == best[q[1]] for q in p[3]), sum(n[q] for q in p[3]), p[4]) for p in per]


ODD = [None, "", " ", "\n", "<|endoftext|> a", "a ▁b", "İ ﬁ ① ½ 日本語 🙂🙂", "é́", "\x00\x01", "  x   y\n\n\nz\t", "<unk> <s>", "don't I'LL", "1234567 89",
       "日本語テキスト", "a" * 500, "x", "x", "́", "don't I'LL"]


def columns(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps, r.n_shared, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = ODD + [r.text[:600] for r in table(spark, SMALL, "documents").collect() if r.text][:60]
    rows = [(i, t, "n_a", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    monkeypatch.setattr(AL, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(AL, "PRODUCT_ENTRIES", 64)
    got = {r.doc_id: columns(r) for r in AL.align(df, AL.byte_bpe(), AL.piece_bpe()).collect()}
    want = brute_alignment(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) >= 3  # null, empty, U+2581


def test_alignment_query_and_links(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = {r.doc_id: r for r in entry.queries()["op13_cross_tokenizer_alignment"](spark, SMALL).collect()}
    assert rows.keys() == docs.keys()
    short = [d for d, t in docs.items() if t and len(t) < 1500][:15]
    alone = dict(zip(short, brute_alignment([docs[d] for d in short])))
    for d in short:  # all but the corpus-wide columns
        got = columns(rows[d])
        assert got[:6] + got[8:] == alone[d][:6] + alone[d][8:]
    df = spark.createDataFrame([(d, docs[d]) for d in short], "doc_id long, text string")
    for kind, at in (("overlap", 4), ("group", 5)):
        n = Counter(r.doc_id for r in AL.token_links(df, AL.byte_bpe(), AL.piece_bpe(), kind).collect())
        assert n == {d: alone[d][at] for d in short}


def test_alignment_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert AL.align(df, AL.byte_bpe(), AL.piece_bpe()).count() == 0
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    out = sorted((repr(r.doc_id), *columns(r)[:4], r.count_sum) for r in AL.align(df, AL.byte_bpe(), AL.piece_bpe()).collect())
    assert out[0] == ("3", 0, 0, 0, 0, 0) and out[1] == out[2] and out[1][5] == 2 * out[1][4]


def test_product_equals_the_dense_one():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.random((5, 7)) < 0.4).astype(int), (rng.random((7, 6)) < 0.4).astype(int)
        rows = lambda m: AL.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        out = np.zeros((5, 6), int)
        for i, j, v in AL.product(rows(a), rows(b), 6):
            out[i, j] = v
        assert (out == a @ b).all()
        t = AL.transposed(rows(b), 6)
        assert (t.start == rows(b.T).start).all() and (t.cols == rows(b.T).cols).all()


def test_vocabularies_give_equal_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(AL.byte_bpe())
    own.encode_special_tokens = True
    fast = AL.ByteBpe(AL.byte_bpe())
    for t in [t for t in ODD if t] + [r.text for r in table(spark, SMALL, "documents").collect() if r.text]:
        assert fast.encode(t) == own.encode(" " + t, add_special_tokens=False).ids, t[:60]
