"""Operator 10: toxicity by maximum-scoring segments.

Words and their beginnings get log-odds of toxic against clean documents with
an informative Dirichlet prior taken from the whole corpus. A linear scan finds every maximal
segment of words with a positive sum of scores; extreme-value statistics
calibrate the sums, and the best one gives the document's score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotzone.llm.common import register, ship, table, written
from hotzone.llm.decontaminate import words_of

ship(__name__)

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Model:
    """``lexicon``: score by token; ``drift``: what every other word costs;
    ``scale``: the extreme-value decay; ``a``, ``b``: the logistic calibration."""

    lexicon: dict[str, float]
    drift: float
    scale: float
    a: float
    b: float
    stems: tuple[int, ...]


def word_tokens(word: str, stems: tuple[int, ...]) -> list[str]:
    """A word's tokens: itself, and its beginnings of the given lengths if it is longer."""
    return ["=" + word, *(word[:k] + "*" for k in stems if len(word) > k)]


class Scores(dict):
    """Score by word (its best token's; 0 if none is in the lexicon), cached up to a bound."""

    def __init__(self, lexicon: dict[str, float], stems: tuple[int, ...]):
        super().__init__()
        self.lexicon, self.stems = lexicon, stems

    def __missing__(self, word: bytes) -> float:
        out = max(self.lexicon.get(t, 0.0) for t in word_tokens(word.decode(), self.stems))
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of a text whose words
    score -drift but for those ``at`` the given places, in linear time.

    Candidates carry the running total before and after them; a new one is
    joined to the nearest earlier one with a smaller left total as long as its
    own right total is larger.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, left total, right total
    total, last = 0.0, 0
    for i, s in zip(at, score):
        total -= drift * (i - last)
        start, left = i, total
        total += s
        last = i + 1
        right = total
        while True:
            j = len(found) - 1
            skipped = []
            while j >= 0 and found[j][2] >= left:
                skipped.append(j)
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, last, left, right))
    return [(a, b, r - lo) for a, b, lo, r in found]


def scan(text: str | None, scores: Scores, drift: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and the maximal segments of a text."""
    words = WORD.findall(text.encode().lower()) if text else []
    s = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(s)
    return len(words), segments(at.tolist(), s[at].tolist(), drift)


def evidence(n: int, found: list[tuple[int, int, float]], scale: float) -> float:
    """The best segment's normalised sum, scale * sum - ln(words), within [-3, 12].
    A clean text reaches x by chance with probability about 1 - exp(-exp(-x))."""
    best = max((s for _, _, s in found), default=0.0)
    return min(max(scale * best - math.log(max(n, 1)), -3.0), 12.0) if best else -3.0


def doc_tokens(text, stems: tuple[int, ...]):
    """The distinct tokens of a text (``word_tokens`` of its words)."""
    def of(w):
        return F.array_compact(F.array(F.concat(F.lit("="), w), *[
            F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in stems]))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words_of(text)), of)))


class Tokens(dict):
    """Numbers of a word's tokens that are among the given ones, cached up to a bound."""

    def __init__(self, tokens: list[str], stems: tuple[int, ...]):
        super().__init__()
        self.at, self.stems = {t: i for i, t in enumerate(tokens)}, stems

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        out = tuple(self.at[t] for t in word_tokens(word.decode(), self.stems) if t in self.at)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def doc_counts(docs: DataFrame, tokens: list[str], stems: tuple[int, ...], text: str) -> DataFrame:
    """``tok, n``: in how many texts each of ``tokens`` occurs (those in none are left out).

    A task counts in one array, so that a row per token and task is shuffled,
    not a row per document and token."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        among, n = Tokens(sent.value, stems), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for t in batch.column(0):
                words = set(WORD.findall(t.as_py().encode().lower())) if t.as_py() else ()
                n[list(set().union(*map(among.__getitem__, words)))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([sent.value[i] for i in some], pa.string()), pa.array(n[some])], names=["tok", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "tok string, n long")
    return counts.groupBy("tok").agg(F.sum("n").alias("n"))


def _decay(scores: np.ndarray, prob: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(x * score)] = 1 over a clean text's words."""
    rest = 1 - prob.sum()

    def excess(x: float) -> float:
        return float(prob @ np.exp(np.minimum(x * scores, 700))) + rest * math.exp(-x * drift) - 1

    lo, hi = 0.0, 1.0
    while excess(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x with smoothed targets and b >= 0, by
    Newton steps that are halved until the loss falls."""
    n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([np.ones_like(x), x], 1)

    def loss(v: np.ndarray) -> float:
        u = z @ v
        return float((w * (np.logaddexp(0, u) - t * u)).sum() + 5e-4 * v[1] ** 2)

    v = np.array([math.log((n1 + 1) / (n0 + 1)), 0.0])
    now = loss(v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        g = z.T @ (w * (t - p)) - np.array([0, 1e-3 * v[1]])
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-9, 1e-3])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-10 and loss(v + step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-10:
            break
        v = v + step
        now = loss(v)
    return float(v[0]), float(max(v[1], 0.0))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample_rows: int = 20_000, stems: tuple[int, ...] = (5, 6, 8), prior_share: float = 0.05, z: float = 2.33,
        min_odds: float = 2.5) -> Model:
    """Learn from labelled rows that are not held out.

    At most ``sample_rows`` labelled documents are used (in the order of a hash
    of their id); tokens of at least two toxic ones that are twice as common
    there as in clean ones are candidates. Their Dirichlet prior counts every
    document of the corpus. A candidate enters the lexicon when its log-odds
    are at least ``min_odds`` and lie ``z`` standard deviations above 0. The bounded sample bounds what is
    broadcast or sent to the driver. Labels with a null id or value are
    ignored; of several for one id the highest holds. Without both classes or
    any candidate the lexicon is empty and all texts get one low score.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    sample = (usable.groupBy(doc_id).agg(F.max(F.col(toxic).cast("int")).alias(toxic))
              .orderBy(F.xxhash64(doc_id), doc_id).limit(sample_rows)).collect()
    sample = spark.createDataFrame([tuple(r) for r in sample], T.StructType([labels.schema[doc_id], T.StructField(toxic, T.IntegerType())]))
    mine = written(docs.select(F.col(doc_id), F.col(text)).join(F.broadcast(sample), doc_id), "labelled")
    size = mine.agg(F.sum((F.col(toxic) == 1).cast("long")), F.sum((F.col(toxic) == 0).cast("long")),
                    F.sum(F.size(words_of(F.col(text))))).first()
    n1, n0, words = (float(v or 0) for v in size)
    empty = Model({}, 0.05, 1.0, -3.0, 0.0, stems)
    if not n1 or not n0:
        return empty
    tok = mine.select(F.explode(doc_tokens(F.col(text), stems)).alias("tok"), toxic)
    cand = (tok.groupBy("tok").agg(F.sum((F.col(toxic) == 1).cast("long")).alias("n1"), F.sum((F.col(toxic) == 0).cast("long")).alias("n0"))
            .filter((F.col("n1") > 1) & (F.col("n1") / n1 > 2 * F.col("n0") / n0)))
    cand = written(cand, "candidates")
    df = doc_counts(docs, [r["tok"] for r in cand.select("tok").collect()], stems, text)
    n = float(docs.count())
    prior = prior_share * (n1 + n0)
    alpha = F.col("n") * (prior / n)
    x1, x0 = F.col("n1") + alpha, F.col("n0") + alpha
    odds = F.log(x1 / (n1 + prior - x1)) - F.log(x0 / (n0 + prior - x0))
    lex = (cand.join(df, "tok").select("tok", odds.alias("d"), (x0 / (n0 + prior)).alias("p"), (1 / x1 + 1 / x0).alias("v"))
           .filter((F.col("d") >= z * F.sqrt("v")) & (F.col("d") >= min_odds)).collect())
    if not lex:
        return empty
    lexicon = {r["tok"]: r["d"] for r in lex}
    hits = tok_rate(mine.filter(F.col(toxic) == 1), lexicon, stems, text)
    drift = -math.log(1 - min(max(hits, 0.005), 0.2))
    scale = _decay(np.array([r["d"] for r in lex]), np.array([r["p"] for r in lex]) * (n1 + n0) / max(words, 1.0), drift)
    draft = Model(lexicon, drift, scale, 0.0, 1.0, stems)
    seen = (_scored(mine, draft, text, "_score", "_predicted", 0.7, passages=None, raw=True)
            .groupBy(toxic, F.round("_score", 2).alias("x")).count().collect())
    a, b = _logistic(*(np.array([float(r[c]) for r in seen]) for c in ("x", toxic, "count")))
    return Model(lexicon, drift, scale, a, b, stems)


def tok_rate(docs: DataFrame, lexicon: dict[str, float], stems: tuple[int, ...], text: str) -> float:
    """Share of the words of ``docs`` that score."""
    def run(batches):
        scores = Scores(lexicon, stems)
        for batch in batches:
            n = h = 0
            for t in batch.column(0):
                words = WORD.findall(t.as_py().encode().lower()) if t.as_py() else []
                n += len(words)
                h += sum(scores[w] > 0 for w in words)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([h])], names=["n", "h"])

    n, h = docs.select(F.col(text)).mapInArrow(run, "n long, h long").agg(F.sum("n"), F.sum("h")).first()
    return float(h or 0) / max(float(n or 0), 1.0)


def _scored(docs: DataFrame, model: Model, text: str, score: str, predicted: str, cut: float, passages: str | None,
            raw: bool = False, p_value: float = 0.05) -> DataFrame:
    keep = [c for c in docs.columns if c not in (score, predicted, passages)]
    src = [c for c in dict.fromkeys([*keep, text])]
    extra = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("sum", T.DoubleType()), T.StructField("p_value", T.DoubleType())])
    if passages:
        extra.append(T.StructField(passages, T.ArrayType(span)))
    schema = T.StructType([docs.schema[c] for c in keep] + extra)

    def run(batches):
        scores = Scores(model.lexicon, model.stems)
        for batch in batches:
            out, hits, spans = [], [], []
            for t in batch.column(text):
                n, found = scan(t.as_py(), scores, model.drift)
                x = evidence(n, found, model.scale)
                p = x if raw else 1 / (1 + math.exp(-max(-30.0, min(30.0, model.a + model.b * x))))
                out.append(p)
                hits.append(int(p >= cut))
                if passages:
                    pv = [(a, b, s, -math.expm1(-n * math.exp(-model.scale * s))) for a, b, s in found]
                    spans.append([dict(zip(("start", "end", "sum", "p_value"), v)) for v in pv if v[3] <= p_value])
            cols = [batch.column(c) for c in keep] + [pa.array(out, pa.float64()), pa.array(hits, pa.int32())]
            if passages:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("p_value", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*src).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.7, score: str = "score",
          predicted: str = "predicted", passages: str | None = "passages") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1), ``predicted`` (score >= cut) and the
    significant passages: word offsets, sum and p-value.

    Null and empty texts have no words and get the score of no evidence. Equal
    rows get equal scores. Columns of docs with the new names are replaced;
    others pass through. A text is read once, in time linear in its words.
    """
    return _scored(docs, model, text, score, predicted, cut, passages)


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """A toxicity score for every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), passages=None)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
