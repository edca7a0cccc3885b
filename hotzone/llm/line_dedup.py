"""Operator 7: line dedup (DataFrame functions only).

Lines are exploded, hashed and counted once per document; lines whose key
lies in too many documents are dropped, and what is left is put together again
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotzone.llm.common import ascii_lower, free_name, register, table, text_key

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, min_chars: int) -> Column:
    """Hash of the stripped, A-Z lower-cased line; null when shorter than ``min_chars`` code points."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(bare) >= min_chars, F.unhex(F.md5(ascii_lower(bare))))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """Keys ``h`` found in at least ``min_docs`` documents (rows). Each document
    names a key once, and counts are combined before the shuffle."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), lambda x: line_key(x, min_chars)))
    return (docs.select(F.explode(keys).alias("h")).filter(F.col("h").isNotNull())
            .groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs))


def _keep(lines: Column, drop: Column) -> Column:
    """``lines`` without the positions in the sorted array ``drop``: the slices between them, in order."""
    bounds = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda j: F.slice(
        lines, F.get(bounds, j) + 2, F.get(bounds, j + 1) - F.get(bounds, j) - 1)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text",
                n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the frequent lines cut from ``text``, plus two counts.

    A document is a row: repeated rows count as documents. Null and empty
    texts are one empty line, which is never dropped; a null text becomes ''.
    A text that loses all its lines becomes ''. Columns of docs named like the
    two counts are replaced; all others pass through. Keyed by text content,
    so null or repeated ids and hot copies need no special case.
    """
    key, drop, = free_name(docs, "key", "drop")
    hot = frequent_lines(docs, min_docs, min_chars, text)
    each = (docs.select(text_key(F.col(text)).alias(key), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
            .select(key, "pos", line_key(F.col("line"), min_chars).alias("h")).filter(F.col("h").isNotNull()))
    dropped = (each.join(hot.select("h"), "h", "left_semi").groupBy(key)
               .agg(F.sort_array(F.collect_set("pos")).alias(drop)))
    out = docs.withColumn(key, text_key(F.col(text))).join(dropped, key, "left")
    keep = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    lines = lines_of(F.col(text))
    return out.select(
        *[F.when(F.col(drop).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
            F.array_join(_keep(lines, F.col(drop)), "\n")).alias(text) if c == text else F.col(c) for c in keep],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped))


@register("op7_line_dedup", sql=r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (key IN (FROM hot)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM hot)), '')) AS kept_sha256
FROM k GROUP BY doc_id
""")
def op7_line_dedup(spark, sf_dir):
    """Lines found in 10 documents or more leave every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
