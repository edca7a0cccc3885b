"""Near-dedup: one row of a group stays, whatever its ids."""

import corpus_pipeline
from hotzone.llm import near_dedup as ND


def test_one_row_of_each_group(spark):
    t, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    short = "only three words"
    rows = [(1, t, "a"), (1, t + " z", "b"), (2, t, "c"), (None, t, "d"), (None, t + " y", "e"), (1, t, "f"),
            (None, other, "g"), (None, other, "h"), (None, other + " x", "i"),
            (None, short, "j"), (None, short, "k"), (4, "", "l"), (None, None, "m"), (None, "", "n"), (4, "alone here", "o"),
            (4, "Alone  here", "p"), (5, "free words", "q"), (5, "of another", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(5)
    got = sorted((str(r.doc_id), r.text or "", r.first) for r in ND.dedup(df).collect())
    near = [g for g in got if g[1].startswith("w0")]
    assert len(near) == 1 and near[0][0] == "1"
    assert len([g for g in got if g[1].startswith("v0")]) == 1 and len([g for g in got if g[1] == short]) == 1
    assert sorted(g[2] for g in got if not g[1]) == ["l", "m", "n"]
    assert len([g for g in got if g[1].lower().split() == ["alone", "here"]]) == 1
    assert [g[2] for g in got if g[0] == "5"] == ["q", "r"]  # not alike: both stay
    assert len(got) == 9


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long, source string")
    from tests.llm.test_other_ops import SMALL
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns
