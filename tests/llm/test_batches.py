"""The corpus pipeline's rows go to Python in small batches."""

import pyarrow as pa

import corpus_pipeline
from hotzone.session import configure


def test_pipeline_stages_send_small_batches(spark, tmp_path):
    spark.createDataFrame([(i, f"i{i}", "a benchmark item of some words") for i in range(3)], "id long, item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    long_texts = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 100000) AS text")

    def largest():
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        return max(r.n for r in long_texts.mapInArrow(run, "n long").collect())

    for _, stage in corpus_pipeline.STAGES:
        configure(spark)
        assert largest() > 4_000_000
        stage(spark, docs, str(tmp_path))
        assert largest() < 2_000_000
    configure(spark)
