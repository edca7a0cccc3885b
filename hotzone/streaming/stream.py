"""Structured Streaming jobs (H1-H9).

* ``stream_events``: file source (Parquet) read ``files_per_batch`` files per
  micro-batch, mapped to feature rows with row-level (map-only) operators.
* ``dedupe``: ids within a watermark delay (bounded state), or exactly, by keyed
  state in RocksDB: a batch looks up its own ids only.
* ``run_ticks``: ``foreachBatch`` job behind the exact dedupe. Each micro-batch
  (1) writes its new rows, whatever their date, (2) finds the scoring ticks that
  they affect, from their dates alone, and (3) rescores exactly those ticks
  from the buckets of the dates in their windows, each batch's summed once from
  its own rows, and overwrites their partitions, then
  replaces the alerts and anomalies of those ticks, also by nothing, and
  forecasts and validates the newest tick. Late or out-of-order files therefore
  converge to the same score history as the batch job; a batch without new rows
  ends after step 1. A failing ingest or score step raises, so the batch is run
  again and no row is lost; a later step that fails twice is recorded in an
  error table, and its ticks stay in the step ledger until it succeeds.
* ``stream_hourly``: event-time hourly counts with a watermark, update mode,
  upserted per micro-batch.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotzone.operators import features as FT
from hotzone.operators.ranking import latest_global, latest_per_key
from hotzone.operators.scoring import _bucket_unit, merged_buckets, score_ticks, tick_buckets
from hotzone.sources.events import violations_raw_from_events

#: Bytes of a row group of the replayed files: one file a batch is still read by many tasks.
ROW_GROUP = 4 << 20
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def write_source_files(events: DataFrame, folder: str, files: int, key: str = "event_id") -> str:
    """Lay a table out as ``files`` Parquet files, each a contiguous key range,
    so it can be replayed as a file stream."""
    events.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return folder


def row_features(raw: DataFrame) -> DataFrame:
    """Feature rows from raw rows with map-only operators (box, weights,
    labels, impact, calendar); the device class needs history and is left out."""
    df = FT.drop_rejected(FT.add_weights(FT.geo_filter(raw)))
    return FT.add_impact_and_calendar(FT.add_label_scores(df)).drop("labels")


def stream_events(spark: SparkSession, folder: str, files_per_batch: int = 1,
                  schema: str = EVENTS_SCHEMA) -> DataFrame:
    """Replay source (H1): feature rows of the event files, with the zones the
    data carries as clusters."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return FT.with_given_zones(row_features(violations_raw_from_events(src)))


#: State partitions at least; each is opened and committed in every batch, so more than the cores need only cost time.
STATE_PARTITIONS = 32
ADAPTIVE = "spark.sql.adaptive.enabled"
SHUFFLE = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe(stream: DataFrame, delay: str | None = "1 day", key: str = "id", ts: str = "created_datetime") -> DataFrame:
    """Drop repeated ids (H2, H9). With a ``delay``, repeats within it: state is
    kept for ``delay`` past the newest event time, rows later than that are
    dropped. Without, all repeats, whenever they come: the ids are keyed state
    on disk, so a batch's reads follow its own rows. One of the rows that
    repeat an id within a batch stays."""
    if delay is None:
        conf = stream.sparkSession.conf  # state on disk, and only a batch's changes uploaded
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


_TRACE = bool(os.environ.get("HOTZONE_TRACE"))


def _mark(label: str, t0: list) -> None:
    """Step timing on stderr when HOTZONE_TRACE is set."""
    if _TRACE:
        now = time.perf_counter()
        print(f"[tick] {label}: {now - t0[0]:.2f}s", file=sys.stderr, flush=True)
        t0[0] = now


def dropped_by_watermark(query) -> int:
    """Rows the query's stateful operators dropped as later than the watermark
    (H9), summed over the query's recent progress reports."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) or []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` holds any partition or file yet; any other
    trouble with it is raised when it is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not st.getPath().getName().startswith("_") for st in fs.listStatus(p))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _stored(spark, path) else None


def _midnights(lo: dt.datetime, hi: dt.datetime) -> list[dt.datetime]:
    """Midnights t with lo < t <= hi."""
    t = dt.datetime(lo.year, lo.month, lo.day) + dt.timedelta(days=1)
    out = []
    while t <= hi:
        out.append(t)
        t += dt.timedelta(days=1)
    return out


TICK_ID = "%Y%m%d%H%M%S"
LEDGER = "step string, state string, owed array<timestamp_ntz>"


def tick_id(col: str = "recalculated_at"):
    return F.date_format(F.col(col), "yyyyMMddHHmmss")


def affected_ticks(dates: list[dt.date], before: dt.datetime | None, first: dt.datetime, last: dt.datetime,
                   window_days: int, steps: list[dt.timedelta]) -> list[dt.datetime]:
    """The ticks after ``first`` and up to ``last`` whose window holds one of
    ``dates``, or that come up now because the log ended at ``before`` (their
    windows hold rows from there). ``steps`` are the ticks' times of day."""
    days = set(dates)
    if before is not None and last > before:
        days |= {before.date() - dt.timedelta(days=k) for k in range(window_days + 1)}
    out = {dt.datetime.combine(d, dt.time(0)) + dt.timedelta(days=k) + at
           for d in days for k in range(window_days + 2) for at in steps}
    old = {t for t in out if before is not None and t <= before and not any(
        t - dt.timedelta(days=window_days) < dt.datetime.combine(d, dt.time(0)) + dt.timedelta(days=1)
        and dt.datetime.combine(d, dt.time(0)) < t for d in dates)}
    return sorted(t for t in out - old if first < t <= last)


def run_ticks(stream: DataFrame, folder: str, window_days: int = 7, meta: DataFrame | None = None,
              baseline: DataFrame | None = None, forecaster=None, trigger_available_now: bool = True,
              processing_time: str | None = None, ts: str = "created_datetime", ticks_per_day: int = 1, keep: dt.timedelta | None = None):
    """Start the tick job (H4, H5, H7, H8): returns the StreamingQuery.

    Steps per micro-batch: ingest, score the affected ticks (``ticks_per_day``
    of them, evenly spaced from midnight), then, from the stored score history,
    tier alerts, rate anomalies against the static ``baseline`` (stream-static
    join), and with ``forecaster`` (a fitted ``ForecastModel``) the forecast of
    the newest tick and the validation of its first predictions. ``keep`` drops
    score partitions older than that before the newest tick.

    Tables under ``folder``: ``log`` (by batch and date), ``buckets`` (by batch), ``scores`` (by tick),
    ``alerts``, ``anomalies``, ``forecasts``, ``validations`` and ``rescored``
    (by batch; see :func:`read_alerts`), ``errors``, ``ledger`` (by batch: each
    step's state and the ticks it still owes), ``state``, ``checkpoint``."""
    spark = stream.sparkSession
    stream = dedupe(stream, None)
    log_path, bucket_path, score_path, ledger_path = (f"{folder}/{t}" for t in ("log", "buckets", "scores", "ledger"))
    err_path, state_path = f"{folder}/errors", f"{folder}/state"
    steps = [dt.timedelta(days=1) * k / ticks_per_day for k in range(ticks_per_day)]
    unit = _bucket_unit([dt.datetime(2000, 1, 1) + at for at in steps])
    dynamic = {"partitionOverwriteMode": "dynamic"}
    ntz = lambda c: c.cast("timestamp_ntz")  # noqa: E731  (session-zone wall clock)

    def record(batch_id: int, step: str, exc: BaseException) -> None:
        row = [(int(batch_id), step, f"{type(exc).__name__}: {exc}", traceback.format_exc()[-2000:])]
        spark.createDataFrame(row, "batch_id long, step string, error string, trace string") \
            .write.mode("append").parquet(err_path)

    def ingest(s: SparkSession, batch: DataFrame, batch_id: int):
        """Write the batch's rows, and their buckets; returns their dates and the log's span before and after, from the written copy."""
        rows, path = batch.withColumn("date", F.to_date(ts)), f"{log_path}/batch_id={int(batch_id)}"
        # rows of a date together, a large date on several tasks: not a file per date of every state partition
        rows.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(path)
        new = s.read.schema(rows.schema).parquet(path)
        tick_buckets(new, unit, ts).write.mode("overwrite").parquet(f"{bucket_path}/batch_id={int(batch_id)}")
        span = new.agg(F.collect_set("date").alias("dates"), ntz(F.min(ts)).alias("lo"), ntz(F.max(ts)).alias("hi")).first()
        if span["lo"] is None:
            return None
        state = "batch_id long, lo timestamp_ntz, hi timestamp_ntz"
        before = None
        if _stored(s, state_path):
            before = s.read.schema(state).parquet(state_path).filter(F.col("batch_id") != batch_id).agg(F.min("lo"), F.max("hi")).first()
        s.createDataFrame([(int(batch_id), span["lo"], span["hi"])], state) \
            .write.mode("overwrite").options(**dynamic).partitionBy("batch_id").parquet(state_path)
        old_lo, old_hi = before if before is not None else (None, None)
        return span["dates"], old_hi, min(span["lo"], old_lo or span["lo"]), max(span["hi"], old_hi or span["hi"])

    def owed(s: SparkSession, batch_id: int) -> dict[str, set[dt.datetime]]:
        """The ticks that each step still owes after the batch before; its ledger carries all that is open."""
        path = f"{ledger_path}/batch_id={int(batch_id) - 1}"
        rows = s.read.schema(LEDGER).parquet(path).collect() if _stored(s, path) else []
        return {r["step"]: set(r["owed"]) for r in rows if r["owed"]}

    def replace(s: SparkSession, name: str, rows: DataFrame, ticks: list[dt.datetime], batch_id: int) -> None:
        """The batch's version of a table's ticks; the list of ticks is written last and makes it current."""
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={int(batch_id)}")
        s.createDataFrame([(t,) for t in ticks], "tick timestamp_ntz").coalesce(1) \
            .write.mode("overwrite").parquet(f"{folder}/rescored/{name}/batch_id={int(batch_id)}")

    def tick_table(s: SparkSession, values, name: str) -> DataFrame:
        rows = [(t.isoformat(sep=" "),) for t in sorted(values)]
        return s.createDataFrame(rows, "_t string").select(F.col("_t").cast("timestamp").alias(name))

    def neighbours(ticks: list[dt.datetime], by: int) -> set[dt.datetime]:
        return {t + by * dt.timedelta(days=1) / ticks_per_day for t in ticks}

    def alerts(s: SparkSession, ticks: list[dt.datetime], batch_id: int) -> None:
        """Alerts of the rescored ticks and of the tick after each (its previous tick changed)."""
        from hotzone.operators.alerts import tier_alerts

        affected = set(ticks) | neighbours(ticks, 1)
        needed = affected | neighbours(affected, -1)
        al = tier_alerts(scores_of(s, needed)).join(F.broadcast(tick_table(s, affected, "triggered_at")), "triggered_at", "left_semi")
        replace(s, "alerts", al, sorted(affected), batch_id)

    def anomalies(s: SparkSession, ticks: list[dt.datetime], batch_id: int) -> None:
        from hotzone.operators.alerts import rate_anomalies

        replace(s, "anomalies", rate_anomalies(scores_of(s, ticks), baseline), ticks, batch_id)

    def forecasts(s: SparkSession, ticks: list[dt.datetime], batch_id: int) -> None:
        from hotzone.operators.aggregates import active_clusters
        from hotzone.operators.forecast import forecast

        replace(s, "forecasts", forecast(forecaster, active_clusters(s.read.parquet(bucket_path)), max(ticks), meta=meta), [max(ticks)], batch_id)

    def validations(s: SparkSession, ticks: list[dt.datetime], batch_id: int) -> None:
        """The first predictions of the newest run, judged anew when it is run again."""
        from hotzone.operators.forecast import validate, validation_candidates

        found = validate(validation_candidates(read_forecasts(s, folder), scores_of(s, [max(ticks)])))
        replace(s, "validations", found, [max(ticks)], batch_id)

    def retention(s: SparkSession, ticks: list[dt.datetime], batch_id: int) -> None:
        _drop_older(s, score_path, max(ticks) - keep)

    later = [("alerts", alerts)]
    if baseline is not None:
        later.append(("anomalies", anomalies))
    if forecaster is not None:
        later += [("forecasts", forecasts), ("validations", validations)]
    if keep is not None:
        later.append(("retention", retention))

    def scores_of(s: SparkSession, ticks) -> DataFrame:
        return s.read.parquet(score_path).filter(F.col("tick_id").isin([t.strftime(TICK_ID) for t in sorted(ticks)])).drop("tick_id")

    def step(batch: DataFrame, batch_id: int) -> None:
        conf = batch.sparkSession.conf  # streams turn adaptive plans off in their session; the steps are batch jobs
        before = conf.get(ADAPTIVE)
        conf.set(ADAPTIVE, "true")
        try:
            steps_of(batch, batch_id)
        finally:
            conf.set(ADAPTIVE, before)

    def steps_of(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        t0 = [time.perf_counter()]
        got = ingest(s, batch, batch_id)  # an error here or in scoring fails the batch, which is then run again
        _mark("ingest", t0)
        ticks = affected_ticks(*got, window_days, steps) if got else []
        if ticks:
            first = (min(ticks) - dt.timedelta(days=window_days)).date()
            buckets = s.read.parquet(bucket_path).filter(F.to_date("_d").between(F.lit(first), F.lit(max(ticks).date())))
            scored = score_ticks(s, merged_buckets(buckets), ticks, window_days, meta=meta, bucketed=True)
            scored.withColumn("tick_id", tick_id()).write.mode("overwrite").options(**dynamic).partitionBy("tick_id").parquet(score_path)
            _mark(f"score {len(ticks)} ticks", t0)
        open_ = owed(s, batch_id)
        entries = []
        for name, run in later:
            todo = sorted(set(ticks) | open_.get(name, set()))
            if not todo:
                continue
            for left in (1, 0):
                try:
                    run(s, todo, batch_id)
                    entries.append((name, "done", []))
                    break
                except Exception as exc:
                    if not left:
                        record(batch_id, name, exc)
                        entries.append((name, "failed", todo))
            _mark(name, t0)
        if entries:
            s.createDataFrame(entries, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/batch_id={int(batch_id)}")

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime=processing_time or "30 seconds")
    wanted = spark.conf.get(SHUFFLE)  # read once, when the query starts
    spark.conf.set(SHUFFLE, str(min(int(wanted), max(STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism))))
    try:
        return w.start()
    finally:
        spark.conf.set(SHUFFLE, wanted)


def _drop_older(spark: SparkSession, path: str, oldest: dt.datetime) -> None:
    """Delete the tick partitions before ``oldest``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("tick_id=") and name[len("tick_id="):] < oldest.strftime(TICK_ID):
            fs.delete(st.getPath(), True)


def _current(spark: SparkSession, folder: str, name: str, at: str) -> DataFrame:
    """The rows of each tick from the newest batch that rescored it."""
    newest = (spark.read.parquet(f"{folder}/rescored/{name}").groupBy(F.col("tick").cast("timestamp").alias(at))
              .agg(F.max("batch_id").alias("batch_id")))
    return spark.read.parquet(f"{folder}/{name}").join(newest, [at, "batch_id"]).drop("batch_id")


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Current tier alerts of the tick job."""
    return _current(spark, folder, "alerts", "triggered_at")


def read_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Current rate anomalies of the tick job."""
    return _current(spark, folder, "anomalies", "detected_at")


def read_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest forecast run of the tick job."""
    return latest_global(_current(spark, folder, "forecasts", "forecast_at"), "forecast_at")


def read_validations(spark: SparkSession, folder: str) -> DataFrame:
    """Current validations of the tick job."""
    return _current(spark, folder, "validations", "forecast_at")


def stream_hourly(stream: DataFrame, folder: str, delay: str = "1 day", ts: str = "created_datetime"):
    """Event-time counts per zone and hour (H6). Update mode: each micro-batch
    emits the changed (cluster, hour) counts, appended under its batch id; the
    current table is the newest row per key (see :func:`read_hourly`)."""
    counts = (stream.filter(F.col("cluster") != -1).withWatermark(ts, delay)
              .groupBy("cluster", F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
              .select("cluster", F.col("w.start").alias("hour_start"), "n"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        (batch.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/hourly"))

    return (counts.writeStream.outputMode("update").foreachBatch(upsert)
            .option("checkpointLocation", f"{folder}/hourly_checkpoint").trigger(availableNow=True).start())


def read_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Current hourly counts: the row of the newest batch per (cluster, hour)."""
    h = spark.read.parquet(f"{folder}/hourly").withColumn("_key", F.concat_ws("|", "cluster", "hour_start"))
    return latest_per_key(h, "_key", "batch_id").drop("_key", "batch_id")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/scores").drop("tick_id")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/log").drop("batch_id", "date")
