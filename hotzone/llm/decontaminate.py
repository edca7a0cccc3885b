"""Operator 1: benchmark decontamination (DataFrame functions only).

The benchmark's word windows are a hash set that is broadcast (behind a check
of its size); every word window of every document probes it, and hits are
verified by comparing the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotzone.llm.common import ascii_lower, free_name, register, table, text_key, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Words of the A-Z lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _window_hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(k)])


def _hash_by_length(words: Column, i: Column, k: Column, lengths: list[int]) -> Column:
    if len(lengths) == 1:
        return _window_hash(words, i, lengths[0])
    out = F.when(k == lengths[0], _window_hash(words, i, lengths[0]))
    for n in lengths[1:]:
        out = out.when(k == n, _window_hash(words, i, n))
    return out


def benchmark_windows(benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct ``k, window, item``: every run of ``n`` words of an item, or the
    whole item when it has fewer words but some. A null item id reads as ''."""
    w = (benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))
         .filter(F.size("w") > 0)
         .select("item", "w", F.least(F.size("w"), F.lit(n)).alias("k")))
    w = w.select("item", "w", "k", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("i"))
    return w.select("k", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("k"))).alias("window"), "item").distinct()


def find_hits(docs: DataFrame, windows: DataFrame, text: str = "text",
              broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified occurrences ``key, i, k, window`` (word offset, length), one row
    per distinct text and place. ``key`` is the text's content key.

    Scan, hash and probe are one code-generated stage with no shuffle of
    document words. Above ``broadcast_windows`` distinct windows the set is
    joined by a shuffle of (hash, key, offset) rows instead.
    """
    win = windows.select("k", "window").distinct().withColumn("bw", F.split("window", " "))
    stats = win.groupBy("k").count().collect()  # at most n rows
    lengths = sorted((r["k"] for r in stats), reverse=True)
    if not lengths:
        lengths = [1]
    total = sum(r["count"] for r in stats)
    win = win.select(_hash_by_length(F.col("bw"), F.lit(0), F.col("k"), lengths).alias("h"),
                     F.col("k").alias("wk"), "window")
    m = len(lengths)
    toks = (docs.select(text_key(F.col(text)).alias("key"), words_of(F.col(text)).alias("w"))
            .filter(F.size("w") >= min(lengths)))
    if m == 1:
        scan = toks.select("key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("i"))
        scan = scan.withColumn("k", F.lit(lengths[0]))
    else:
        scan = toks.select("key", "w", F.explode(F.sequence(F.lit(0), F.size("w") * m - 1)).alias("p"))
        scan = (scan.withColumn("i", F.floor(F.col("p") / m).cast("int"))
                .withColumn("k", F.get(F.array(*[F.lit(x) for x in lengths]), F.col("p") % m))
                .filter(F.col("i") + F.col("k") <= F.size("w")))
    scan = scan.withColumn("h", _hash_by_length(F.col("w"), F.col("i"), F.col("k"), lengths))
    same = F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("k"))) == F.col("window")
    if total <= broadcast_windows:
        hit = scan.join(F.broadcast(win), (scan["h"] == win["h"]) & (F.col("k") == F.col("wk")) & same)
        return hit.select("key", "i", "k", "window").distinct()
    narrow = scan.select("key", "i", "k", "h", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("k"))).alias("t"))
    hit = narrow.join(win, (narrow["h"] == win["h"]) & (F.col("k") == F.col("wk")) & (F.col("t") == F.col("window")))
    return hit.select("key", "i", "k", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text",
                  item: str = "item_id", bench_text: str = "text",
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per distinct contaminated text: ``key, n_hit, n_items, items, spans``.

    ``spans`` are the hits as (start, end) word offsets, sorted; ``n_hit``
    counts the words inside any of them; ``items`` are the item ids, sorted as
    strings.
    """
    windows = benchmark_windows(benchmark, n, bench_text, item)
    hits = written(find_hits(docs, windows, text, broadcast_windows), "hits")  # few rows, read three times
    w = Window.partitionBy("key").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("i") + F.col("k")
    spans = (hits.select("key", "i", "k").withColumn("seen", F.coalesce(F.max(end).over(w), F.lit(0)))
             .groupBy("key").agg(
                 F.sum(F.greatest(F.lit(0), end - F.greatest("i", "seen"))).alias("n_hit"),
                 F.sort_array(F.collect_list(F.struct(F.col("i").alias("start"), end.alias("end")))).alias("spans")))
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    per = hits.select("key", "window").distinct()
    items = (per.join(F.broadcast(windows) if small else windows, "window").select("key", "item").distinct()
             .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return spans.join(items, "key").select("key", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words inside ``spans`` and the separators after them."""
    words = F.array_remove(F.split(text, NOT_WORD_CASED), "")
    seps = F.split(text, WORD_CASED)
    kept = F.transform(words, lambda x, i: F.when(
        F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")).otherwise(
        F.concat(x, F.get(seps, i + 1))))
    return F.concat(F.get(seps, F.lit(0)), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "flag", n: int = 10, text: str = "text",
                  **kw) -> DataFrame:
    """``docs`` checked against ``benchmark``.

    mode ``flag``: all rows and columns, plus n_words, n_hit, n_items,
    items_sha256, contaminated; a column of docs with such a name is replaced.
    ``documents``: the clean rows, columns unchanged. ``spans``: all rows, hit
    words cut from the text, columns unchanged.

    Null or empty texts have no words and are clean. Equal rows get equal
    results each. An empty benchmark marks nothing. Very long texts are
    scanned whole.
    """
    key, cnt, = free_name(docs, "key", "hit")
    found = contamination(docs, benchmark, n, text, **kw)
    found = found.select(F.col("key").alias(key), F.struct("n_hit", "n_items", "items", "spans").alias(cnt))
    keyed = docs.withColumn(key, text_key(F.col(text)))
    if mode == "documents":
        return keyed.join(found, key, "left_anti").select(*docs.columns)
    if mode == "spans":
        out = keyed.join(found, key, "left")
        return out.withColumn(text, F.when(F.col(cnt).isNull(), F.col(text)).otherwise(
            remove_spans(F.col(text), F.col(cnt)["spans"]))).select(*docs.columns)
    if mode != "flag":
        raise ValueError(f"unknown mode {mode}")
    out = keyed.withColumn("n_words", F.size(words_of(F.col(text))).cast("long"))
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    out = out.select(*keep, key, "n_words").join(found, key, "left")
    hit = F.col(cnt)
    return out.select(
        *keep, "n_words", F.coalesce(hit["n_hit"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(hit["n_items"], F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", hit["items"]), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce(hit["n_hit"], F.lit(0)) > 0).alias("contaminated"))


@register("op1_decontaminate", sql=r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bk AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, item FROM dw JOIN bw USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op1_decontaminate(spark, sf_dir):
    """Documents against the benchmark's 10-word windows (a flag per document)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
