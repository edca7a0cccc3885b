"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

toxicity drops the documents its model rejects; line dedup cuts frequent
lines; near-dedup keeps one document of each group; decontamination drops the
documents that hold benchmark passages; packing places the rest in sequences.
Line dedup sets ``n_chars`` anew with the text. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotzone.llm import toxicity as tox
from hotzone.llm.common import free_name, table, written
from hotzone.llm.decontaminate import decontaminate
from hotzone.llm.line_dedup import dedup_lines
from hotzone.llm.near_dedup import dedup
from hotzone.llm.pack import pack, word_bpe
from hotzone.session import configure_texts


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7 (labels that are not held out train the model)."""
    configure_texts(spark)
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    score, hit = free_name(docs, "score", "predicted")
    scored = tox.score(docs, model, score=score, predicted=hit, passages=None)
    return scored.filter(F.col(hit) == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that 10 or more of them share."""
    configure_texts(spark)
    n, d = free_name(docs, "lines", "dropped")
    out = dedup_lines(docs, n_lines=n, n_dropped=d)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    configure_texts(spark)
    return dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    configure_texts(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, placed in sequences of 4096 tokens."""
    configure_texts(spark)
    return pack(docs, word_bpe())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens, the fitted model and shingle sets are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure_texts(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
