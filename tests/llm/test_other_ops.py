"""Packing, embeddings, pages, toxicity and the pipeline against brute force and exact round trips."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hotzone.llm import embedding_dedup as ED
from hotzone.llm import html_extract as HX
from hotzone.llm import pack as PK
from hotzone.llm import toxicity as TX
from hotzone.llm.common import components, table
from tests.conftest import SMALL
from tests.llm import brute as B


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PK.word_bpe())


def ids_of(tok, text):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


ODD = ["", " ", "\n\n", "It's they'll 'S can't.", "ÉCOLE École école", "á́ ́", "ΣΑΣ Σ", "İstanbul", "x\x0by\x1cz q w",
       "<|endoftext|> a<|startoftext|>b", "123 4½ Ⅳ ²", "日本語 テキスト", "word,,, ,word ... !?", "ﬁ ﬀ K Å", "a" * 300, "<|endoftext|", "🙂🙂 ok🙂"]


def test_encoder_equals_the_tokenizer(spark, tok):
    enc = PK.Encoder(PK.word_bpe())
    texts = ODD + [r.text for r in table(spark, SMALL, "documents").collect()] + [r.text for r in table(spark, SMALL, "conversations").limit(300).collect()]
    for t in texts:
        assert enc.encode(t or "") == ids_of(tok, t)[:-1].tobytes(), t[:80]


def check_packing(rows, texts, tok, max_len):
    """Every piece is the right slice, every sequence is gapless and short enough; returns the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = ids_of(tok, t)
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // max_len)))
        for r in got:
            part = ids[r.piece * max_len:(r.piece + 1) * max_len]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * max_len, len(part), zlib.crc32(part.tobytes()))
    for s in by_seq.values():
        at = 0
        for off, length in sorted(s):
            assert off == at
            at += length
        assert at <= max_len
    return len(by_seq)


@pytest.mark.parametrize("max_len", [4096, 100, 7])
def test_pack(spark, tok, max_len):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = PK.pack(docs.withColumn("rank", F.lit(1)).withColumn("b", F.lit(2)), PK.word_bpe(), max_len).collect()
    n = check_packing(rows, texts, tok, max_len)
    total = sum(r.length for r in rows)
    assert n <= -(-total // max_len) * 1.03 + 1


def test_pack_ids_and_repeated_rows(spark, tok):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "c")] * 30, "doc_id long, text string")
    rows = PK.pack(df, PK.word_bpe(), 16, with_ids=True).collect()
    assert len(rows) == 120
    seqs = defaultdict(dict)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        for k in range(r.length):
            assert seqs[r.sequence_id].setdefault(r.offset + k, r) is r
    assert all(set(s) == set(range(len(s))) and len(s) <= 16 for s in seqs.values())
    assert PK.pack(df.limit(0), PK.word_bpe()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    cap = [16, 4096, 300, 64][seed]
    x = np.clip(rng.lognormal(math.log(cap / 6), 1.0, 3000).astype(int) + 1, 1, cap)
    hist = dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True))))
    plan = PK.plan_runs(hist, cap)
    used = defaultdict(int)
    for k, (length, at, copies, seq, off) in enumerate(plan.tolist()):
        last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else hist[length]
        for d in range(last - at):
            used[seq + d // copies] += length
    assert max(used.values()) <= cap and sum(used.values()) == x.sum()
    assert len(used) <= -(-int(x.sum()) // cap) * 1.05 + 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(130)] + [(7, 7)]
    rnd.shuffle(edges)
    u = B.Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = components(spark.createDataFrame([(b, a) if rnd.random() < 0.5 else (a, b) for a, b in edges], "a long, b long"))
    assert {r.node: r.comp for r in got.collect()} == {x: u.find(x) for x in list(u)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (1, 2):
        base = rng.standard_normal((150, 16))
        for v in base:
            rows.append((k, v.astype(np.float32).tolist(), label))
            k += 1
            for s in (0.03, 0.048, 0.052, 0.06):  # around the threshold
                if rng.random() < 0.5:
                    rows.append((k, (v + s * np.linalg.norm(v) / 4 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                    k += 1
    hub = rng.standard_normal(16)
    rows += [(k + i, hub.tolist(), 1) for i in range(40)] + [(k + 40 + i, (hub * (i + 1)).tolist(), 1) for i in range(5)]
    k += 50
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(k + i, v, 1) for i, v in enumerate(bad)] + [(k + 10 + i, hub.tolist(), None) for i in range(2)]
    rows += [(k + 20, [1e30] * 16, 3), (k + 21, [1e-30] * 16, 3), (k + 22, [1.0] * 8, 3), (k + 23, [2.0] * 8, 3)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, hash string, row int").repartition(4)
    good = [(i, np.array(v, np.float32).astype(float), (lab, len(v))) for i, v, lab in rows
            if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    u, n = B.Union(), dict.fromkeys((r[0] for r in rows), 0)
    for a, (i, x, lx) in enumerate(good):
        for j, y, ly in good[a + 1:]:
            x1, y1 = x / np.abs(x).max(), y / np.abs(y).max() if len(x) == len(y) else y
            if lx == ly and x1 @ y1 / math.sqrt((x1 @ x1) * (y1 @ y1)) >= 0.98:
                n[i] += 1
                n[j] += 1
                u.join(i, j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.near_vectors(df).collect()}
    assert got == {i: (n[i], u.find(i), u.find(i) == i) for i in n}
    assert sum(n.values()) > 1000
    assert ED.near_vectors(df.limit(0)).count() == 0


def test_collisions_count_windows():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((20, 6)), rng.standard_normal((70, 6))
    want = (np.abs(q[:, None, :] - x[None, :, :]) <= 0.4).sum(-1)
    assert (ED.collisions(q, x, 0.4) == want).all()


PAGE = ('<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><nav><a href="/x">menu</a></nav>'
        '<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>{body}<footer>foot</footer>'
        '<script>var t="</p><article>";</script></body></html>')


def test_pages(spark):
    art = '<article><header><h1>A &amp; B</h1></header><p>one <b>two</b>&nbsp;three\n\tfour<p>five<br>six<aside>side</aside><form>f</form><section id="comments"><article class="comment"><p>reader</article></section><p>end</article>'
    plain = [f"<div><p>Welcome to the site</p><p>story {i} itself</p><p>about us</p></div>" for i in range(4)]
    rows = [(1, "http://a.org/x/1", PAGE.replace("{body}", art)), (2, None, None), (3, "http://a.org/x/2", ""), (4, None, "<p>x &lt;y&gt; &#233;<p>z")]
    rows += [(10 + i, f"https://b.org/news/{i}?q=1#t", PAGE.replace("{body}", p)) for i, p in enumerate(plain)]
    rows += [(20, "http://c.org/only", PAGE.replace("{body}", plain[0])), (30, "http://a.org/x/9", "<article><p>cut off in the mid"), (31, "u", "<p title='>'>a<b c=\"x>y\">d"),
             (32, "v", "<p>before <span class='ad'>buy<div>now</div></span>after<p class=comment>c<p>next")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, _row int").repartition(3)
    out = HX.extract_text(df)
    assert sorted(out.columns) == sorted(["page_id", "url", "_row", "text", "n_chars"])
    got = {r.page_id: r.text for r in out.collect()}
    want = {1: "A & B\none two three four\nfive six\nend", 2: "", 3: "", 4: "x <y> é\nz", 20: "Welcome to the site\nstory 0 itself\nabout us",
            30: "cut off in the mid", 31: "ad", 32: "before after\nnext"}
    want.update({10 + i: f"story {i} itself" for i in range(4)})
    assert got == want
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert HX.extract_text(df.limit(0)).count() == 0


def test_shared_lines_is_a_longest_common_subsequence():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(12))] for _ in range(2))
        hit = HX.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
        sub = [x for x, h in zip(a, hit) if h]
        it = iter(b)
        assert all(x in it for x in sub)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(sub) == best[-1][-1]


def test_segments_are_the_maximal_ones():
    """Against the definition by recursion: the best segment, then the same left and right of it."""
    def split(x, at):
        best, span = 0.0, None
        for i in range(len(x)):
            total = 0.0
            for j in range(i, len(x)):
                total += x[j]
                if total > best + 1e-12:
                    best, span = total, (i, j + 1)
        if span is None:
            return []
        i, j = span
        return split(x[:i], at) + [(at + i, at + j, best)] + split(x[j:], at + j)

    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(1, 25)
        hits = {i: rnd.random() * 3 + 0.1 for i in range(n) if rnd.random() < 0.3}
        x = [hits.get(i, -0.37) for i in range(n)]
        got = TX.segments(sorted(hits), [hits[i] for i in sorted(hits)], 0.37)
        assert [(a, b, round(s, 9)) for a, b, s in got] == [(a, b, round(s, 9)) for a, b, s in split(x, 0)]


def toxic_corpus(n=900):
    rnd = random.Random(9)
    vocab, bad = [f"word{i}" for i in range(500)], ["vile", "rotten", "scoundrel", "fiend"]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([8, 60, 300]))]
        y = int(rnd.random() < 0.15)
        if y:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(bad), *[rnd.choice(vocab) for _ in range(2)], rnd.choice(bad), rnd.choice(bad)]
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    ddf = spark.createDataFrame([(*d, "s") for d in docs] + [(5000, None, "s"), (5001, "", "s"), (None, "vile rotten fiend", "s")], "doc_id long, text string, score string").repartition(4)
    ldf = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = TX.fit(ddf, ldf)
    got = {r.doc_id: r for r in TX.score(ddf, model).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 for r in got.values())
    y = dict(labels)
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y[i] for i in held) / len(held) > 0.98
    assert got[5000].predicted == 0 and got[None].predicted == 1
    for i, t in docs:
        for p in got[i].passages:
            assert p.p_value <= 0.05 and 0 <= p.start < p.end <= len(t.split())
    flipped = spark.createDataFrame([(i, 1 - v if i in set(held) else v) for i, v in labels], "doc_id long, toxic int")
    again = TX.fit(ddf, flipped)
    assert again.lexicon == model.lexicon and (again.a, again.b) == (model.a, model.b)  # held-out labels teach nothing
    empty = TX.fit(ddf, ldf.limit(0))
    assert TX.score(ddf, empty).filter("predicted = 1").count() == 0
    assert TX.score(ddf.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        out = stage(spark, seen, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if name == "line_dedup":
            assert sorted(after.items()) == [(d, t) for d, _, _, t in sorted(B.line_dedup(sorted(before.items())))]
        elif name == "near_dedup":
            assert set(after) == {d for d, (_, c) in B.near_dedup(sorted(before.items())).items() if c == d}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
            assert set(after) == {r[0] for r in B.decontaminate(sorted(before.items()), bench) if not r[5]}
        seen = out
    assert corpus_pipeline.run(spark, SMALL).count() == out.count()
