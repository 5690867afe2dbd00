"""Structured Streaming jobs for the ingest and monitoring streams
(A8, A9, S1-S4, S8-S11, S13).

Sources: Kafka in production (the connector must be on the classpath), or
files holding the same record shape (JSON lines of key, value, topic,
partition, offset) where no broker exists.  Every job runs with a
checkpoint in the shared checkpoint folder; sinks are either append-only
file sinks (exactly once through the checkpoint) or ``foreachBatch``
writers that are idempotent per batch id (a re-run batch overwrites its
own output), so a lost executor or a restarted driver never duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.operators import links as lk
from lakeshore.operators import ops
from lakeshore.operators import tasks as tk
from lakeshore.sources import sinks

RECORD_SCHEMA = "key string, value string, topic string, partition int, offset long"


# ---- sources and sinks --------------------------------------------------

def read_records(spark: SparkSession, source: str = "files", path: str | None = None, topic: str | None = None,
                 options: dict | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of records (key, value, topic, partition, offset),
    earliest first."""
    if source == "kafka":
        r = spark.readStream.format("kafka").option("subscribe", topic).option("startingOffsets", "earliest")
        for k, v in (options or {}).items():
            r = r.option(k, v)
        df = r.load()
        return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset")
    r = spark.readStream.schema(RECORD_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.json(path)


def write_records(df: DataFrame, path: str, key_col: str, value_col: str, topic: str, n_files: int = 1,
                  offset_col: str | None = None) -> None:
    """Write rows as records files (the file stand-in for a topic)."""
    off = F.col(offset_col) if offset_col else F.col(key_col)
    recs = df.select(F.col(key_col).cast("string").alias("key"), F.col(value_col).alias("value"),
                     F.lit(topic).alias("topic"), F.pmod(off, F.lit(n_files)).cast("int").alias("partition"),
                     off.cast("long").alias("offset"))
    recs.repartition(n_files, "partition").write.mode("append").json(path)


def run_available(writer_factory: Callable[[], object]) -> None:
    """Start a query with ``trigger(availableNow=True)`` and wait for it."""
    q = writer_factory()
    q.awaitTermination()
    err = q.exception()
    if err is not None:
        raise RuntimeError(str(err))


def _append_stream(df: DataFrame, out: str, checkpoint: str) -> None:
    run_available(lambda: df.writeStream.format("parquet").option("path", out)
                  .option("checkpointLocation", checkpoint).outputMode("append")
                  .trigger(availableNow=True).start())


def _batch_writer(fn: Callable[[DataFrame, int], None], df: DataFrame, checkpoint: str, mode: str = "append") -> None:
    run_available(lambda: df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
                  .outputMode(mode).trigger(availableNow=True).start())


# ---- stream jobs --------------------------------------------------------

def publish_stream(records: DataFrame, out: str, checkpoint: str, topic: str, sink: str = "files",
                   options: dict | None = None) -> None:
    """A9 (stream form): forward records to a topic (Kafka) or a records folder."""
    msgs = records.select("key", "value", F.lit(topic).alias("topic"))
    if sink == "kafka":
        w = msgs.writeStream.format("kafka").option("checkpointLocation", checkpoint)
        for k, v in (options or {}).items():
            w = w.option(k, v)
        run_available(lambda: w.trigger(availableNow=True).start())
    else:
        run_available(lambda: msgs.writeStream.format("json").option("path", out)
                      .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def normalize_stream(records: DataFrame, out: str, checkpoint: str) -> None:
    """Normalised download tasks, appended (stateless)."""
    _append_stream(tk.normalize_download_task(records), out, checkpoint)


def split_poison_stream(records: DataFrame, good_out: str, bad_out: str, checkpoint: str) -> None:
    """Good and bad messages to two outputs in one pass per batch; a
    re-run batch overwrites its own folders (idempotent by batch id)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()     # the source is read once for the two outputs
        try:
            good, bad = tk.split_poison(batch)
            good.write.mode("overwrite").parquet(f"{good_out}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{bad_out}/batch={batch_id}")
        finally:
            batch.unpersist()
    _batch_writer(handle, records, checkpoint)


def upsert_stream(records: DataFrame, table_root: str, checkpoint: str, key: str = "key") -> None:
    """At-least-once delivery made exactly-once in effect.  A message
    without a key is identified by topic, partition and offset, so two of
    them never fall together; offsets are only compared as (offset,
    partition, topic), a fixed order.  Each batch
    writes only its own rows (last per key) to ``batch=<id>`` — a re-run
    batch overwrites the same folder — and readers take the latest row per
    key (``read_latest``): merge on read, so a batch costs O(batch), not
    O(table)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        good, _ = tk.split_poison(batch)
        own = F.concat_ws("/", F.lit("no key"), "topic", "partition", "offset")
        rows = (good.withColumn(key, F.coalesce(F.col(key), own))
                .groupBy(key).agg(F.max_by("value", F.struct("offset", "partition", "topic")).alias("value"))
                .withColumn("batch_id", F.lit(batch_id).cast("long")))
        rows.write.mode("overwrite").parquet(f"{table_root}/batch={batch_id}")
    _batch_writer(handle, records, checkpoint)


def read_latest(spark: SparkSession, table_root: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """Merge on read: the row of the greatest batch id per key."""
    try:
        df = spark.read.parquet(table_root)
    except Exception:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)
    cols = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return latest.select(*keys, *[F.col("_r")[c].alias(c) for c in cols if c != "batch_id"])


def link_stream(records: DataFrame, history_root: str, published: str, checkpoint: str) -> None:
    """Candidate URLs; per batch the first row of each new canonical URL
    is inserted into the link history (A12 against everything seen so far)
    and published; duplicates within and across batches are dropped.  The
    history is append-only: each batch adds its own ``batch=<id>`` folder
    (overwritten on a re-run), so a batch writes O(batch) rows."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cands = batch.select(F.col("offset").alias("id"), F.col("value").alias("url"))
        history = spark.read.schema("id long, url string, url_normalized string, url_hash string, batch_id long") \
            .parquet(history_root).where(F.col("batch_id") < batch_id)
        fresh = lk.insert_new(cands, history.select("url_hash"))
        # Publish first (idempotent per batch id), then record in the history.
        fresh.write.mode("overwrite").parquet(f"{published}/batch={batch_id}")
        spark.read.parquet(f"{published}/batch={batch_id}").write.mode("overwrite") \
            .parquet(f"{history_root}/batch_id={batch_id}")
    _batch_writer(handle, records, checkpoint)


def running_app_stats(requests: DataFrame, out: str, checkpoint: str) -> None:
    """Per-app running statistics; the streaming aggregate keeps the
    state, each batch writes the complete result as the next version of the
    table (readers take the newest finished one, never a half-written one)."""
    agg = ops.request_stats(requests)

    def handle(batch: DataFrame, batch_id: int) -> None:
        sinks.write_version(batch, out)
    _batch_writer(handle, agg, checkpoint, mode="complete")


def snapshot_stream(requests: DataFrame, table_root: str, checkpoint: str, interval_sec: int = 60,
                    watermark: str = "10 minutes") -> None:
    """Per app and interval: requests and the interval's peak, in
    update mode with a watermark (bounded state); updated windows are
    upserted into the result table.  The running peak over intervals is
    a property of the stored table (``with_running_peak``)."""
    # Event time must be a zoned TIMESTAMP for watermarks; the session time
    # zone makes the cast exact and the window start is cast back.
    ntz = dict(requests.dtypes).get("captured_at") == "timestamp_ntz"
    ev = requests.withColumn("_et", F.col("captured_at").cast("timestamp"))
    w = F.window("_et", f"{interval_sec} seconds")
    per = (ev.withWatermark("_et", watermark).groupBy("app_name", w.alias("w"))
           .agg(F.count(F.lit(1)).alias("requests_count"),
                F.max(F.greatest("rss_before_mb", "rss_after_mb")).alias("window_peak"),
                F.max_by("rss_before_mb", F.struct("captured_at", "id")).alias("rss_mb"))
           .select("app_name", F.col("w.start").cast("timestamp_ntz" if ntz else "timestamp").alias("captured_at"),
                   "requests_count", "window_peak", "rss_mb"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Updated windows of this batch only; readers keep the latest per
        # (app, window) with ``read_latest``.
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
            .parquet(f"{table_root}/batch={batch_id}")
    _batch_writer(handle, per, checkpoint, mode="update")


def with_running_peak(snap: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    run = Window.partitionBy("app_name").orderBy("captured_at").rowsBetween(Window.unboundedPreceding, 0)
    return snap.select("app_name", "captured_at", "rss_mb", "requests_count",
                       F.max("window_peak").over(run).alias("peak_rss_mb"))


def alert_stream(requests: DataFrame, out: str, checkpoint: str) -> None:
    """One alert row per request over a threshold (stateless append)."""
    _append_stream(ops.alerts(requests), out, checkpoint)


def heavy_stream(requests: DataFrame, out: str, checkpoint: str) -> None:
    """Persist only heavy requests (stateless append)."""
    _append_stream(ops.heavy_only(requests), out, checkpoint)


RETRY_SCHEMA = "key string, value string, attempt int, next_at double, error string"


def retry_then_dlq(records: DataFrame, handler: Callable[[DataFrame], DataFrame], out: str, retry_root: str,
                   dlq_out: str, bad_out: str, checkpoint: str, max_retries: int = 5, base_sec: float = 30.0,
                   cap_sec: float = 300.0, clock: Callable[[int], float] | None = None) -> None:
    """S3: a failing message is retried with delay min(base * attempt, cap);
    after ``max_retries`` retries it goes to the dead-letter output.

    ``handler(df)`` gets (key, value, attempt) rows and returns them with an
    ``error`` column (null = success).  Nothing sleeps inside a batch:
    failures wait with ``attempt`` and ``next_at``; each later batch takes
    the due ones along with its new messages (a trigger without new data
    needs a heartbeat message).  What waits after batch n is the folder
    ``batch=n`` below ``retry_root``; batch n reads the newest folder before
    n and rewrites all its own outputs, so a replayed batch starts from the
    same state and leaves every message in exactly one output.  The handler
    runs once per batch: its result is written before it is divided.
    Messages that are not JSON go to ``bad_out`` without retries.
    """
    import time as _time

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = clock(batch_id) if clock else _time.time()
        good, bad = tk.split_poison(batch)
        bad.write.mode("overwrite").parquet(f"{bad_out}/batch={batch_id}")
        before = [int(d[6:]) for d in sinks.list_dirs(spark, retry_root) if d.startswith("batch=")]
        before = [b for b in before if b < batch_id and sinks.exists(spark, f"{retry_root}/batch={b}/_SUCCESS")]
        pending = (spark.read.schema(RETRY_SCHEMA).parquet(f"{retry_root}/batch={max(before)}") if before
                   else spark.createDataFrame([], RETRY_SCHEMA))
        due = pending.where(F.col("next_at") <= F.lit(now))
        later = pending.where(F.col("next_at") > F.lit(now))
        work = (good.select("key", "value", F.lit(1).alias("attempt"))
                .unionByName(due.select("key", "value", (F.col("attempt") + 1).alias("attempt"))))
        handled = f"{retry_root}/handled={batch_id}"
        handler(work).write.mode("overwrite").parquet(handled)
        res = spark.read.parquet(handled)
        res.where(F.col("error").isNull()).select("key", "value", "attempt") \
            .write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        failed = res.where(F.col("error").isNotNull())
        failed.where(F.col("attempt") > max_retries).select("key", "value", "attempt", "error") \
            .write.mode("overwrite").parquet(f"{dlq_out}/batch={batch_id}")
        retry = failed.where(F.col("attempt") <= max_retries).select(
            "key", "value", "attempt",
            (F.lit(now) + F.least(F.lit(base_sec) * F.col("attempt"), F.lit(cap_sec))).alias("next_at"), "error")
        later.unionByName(retry).write.mode("overwrite").parquet(f"{retry_root}/batch={batch_id}")
    _batch_writer(handle, records, checkpoint)


VERIFY_SCHEMA = ("task_id string, entity string, folder_path string, split_columns array<string>, "
                 "split_column string, download_result struct<status:string>")


def folder_stage(records: DataFrame, raw_root: str, temp_root: str, allowed: list[str], config: dict,
                 results_out: str, sums_out: str, checkpoint: str, verification: bool = True) -> None:
    """S5 (``verification=True``) and S7: each micro-batch's task messages
    are resolved (split columns from the message, then the config) and
    their folders are split and control-summed by ``process_folders`` (one
    Spark job per split-column list).  Results are keyed by task_id and
    written per batch id; an inner error is reported as an error."""
    from lakeshore.operators.folders import process_folders

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, _ = tk.split_poison(batch)
        m = good.select(F.from_json("value", VERIFY_SCHEMA).alias("m")).select("m.*")
        cols = F.coalesce(F.col("split_columns"),
                          F.when(F.col("split_column").isNotNull(), F.array("split_column")),
                          F.array().cast("array<string>"))
        tasks = m.select("task_id", F.col("folder_path").alias("folder"), cols.alias("split_columns"),
                         (F.col("download_result.status") if verification else F.lit(None).cast("string"))
                         .alias("download_status"))
        res, sums = process_folders(spark, tasks, raw_root, temp_root, allowed, config,
                                    no_split="completed" if verification else "error")
        res.write.mode("overwrite").parquet(f"{results_out}/batch={batch_id}")
        sums.write.mode("overwrite").parquet(f"{sums_out}/batch={batch_id}")
    _batch_writer(handle, records, checkpoint)
