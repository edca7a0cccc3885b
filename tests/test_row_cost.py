"""What a row costs on the way to the feature table, and how replayed files are read."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hotzone.operators.features import geo_filter
from hotzone.session import COMPILED_BYTES, configure
from hotzone.sources.events import violations_raw_from_events
from hotzone.streaming import stream as ST


def events(spark, n=6):
    rows = [(i, 1000 + i, "click", '{"k": %d}' % (i * 17 % 100) if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    return df.withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"))


def test_filter_parses_the_text_once(spark):
    raw = violations_raw_from_events(events(spark))
    assert raw.count() == 6 and raw.filter("true_zone IS NULL OR true_zone = -1").count() >= 1  # rows without the text stay
    plan = geo_filter(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_methods_are_small_enough_to_be_compiled(spark):
    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == COMPILED_BYTES <= 8000


def test_replayed_file_is_cut_in_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "ROW_GROUP", 1 << 16)
    wide = spark.range(60_000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("props"))
    folder = ST.write_source_files(wide, str(tmp_path / "src"), 1)
    files = glob.glob(f"{folder}/*.parquet")
    assert len(files) == 1 and pq.ParquetFile(files[0]).num_row_groups > 1
