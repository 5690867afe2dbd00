"""Query bindings for the stream jobs (T): the input view is written as
record files in a fresh folder under the shared checkpoint folder, the
stream runs with ``trigger(availableNow=True)`` and the result table is
read back.  Where the result is a relational fact, the oracle is the same
SQL as the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.plans.q_links import _NORM as _URL_NORM, _STATUS
from lakeshore.plans.q_ops import _ALERTS_SQL, _STATS_SQL
from lakeshore.plans.q_tasks import _NORM as _TASK_NORM
from lakeshore.plans.registry import ORACLES, query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir
from lakeshore.sources import sinks
from lakeshore.streaming import jobs


def _records(spark, sf_dir, view_name, key, value, topic, n_files=1, offset=None):
    path = scratch_dir(spark, f"in-{topic}")
    jobs.write_records(view(spark, sf_dir, view_name), path, key, value, topic, n_files, offset)
    return path


def _requests_stream(spark, sf_dir, max_files=None):
    path = scratch_dir(spark, "in-requests")
    ev = view(spark, sf_dir, "events_mon")
    ev.repartition(4).write.parquet(path)
    r = spark.readStream.schema(ev.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


@query("read_tasks_stream", with_views(["tasks"], """
SELECT id AS key, value, 'tasks' AS topic, CAST(id % 4 AS INT) AS partition, id AS offset FROM tasks
"""))
def q_read_tasks_stream(spark, sf_dir):
    src = _records(spark, sf_dir, "tasks", "id", "value", "tasks", 4)
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs._append_stream(jobs.read_records(spark, path=src, max_files_per_trigger=2), out, ck)
    return spark.read.parquet(out).withColumn("key", F.col("key").cast("bigint"))


@query("write_messages", with_views(["tasks"], "SELECT CAST(id AS STRING) AS key, value, 'tasks-out' AS topic FROM tasks"))
def q_write_messages(spark, sf_dir):
    src = _records(spark, sf_dir, "tasks", "id", "value", "tasks", 2)
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs.publish_stream(jobs.read_records(spark, path=src), out, ck, "tasks-out")
    return spark.read.schema("key string, value string, topic string").json(out)


@query("normalize_task_stream", with_views(["download_msgs"], "SELECT * FROM norm", norm=_TASK_NORM))
def q_normalize_task_stream(spark, sf_dir):
    src = _records(spark, sf_dir, "download_msgs", "id", "value", "download", 3)
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs.normalize_stream(jobs.read_records(spark, path=src, max_files_per_trigger=1), out, ck)
    n = spark.read.parquet(out)
    return n.select(F.col("key").cast("bigint").alias("id"), "poison", "entity", "updated_at", "period",
                    F.size("urls").alias("n_urls"), F.try_element_at("urls", F.lit(1)).alias("first_url"))


@query("split_poison_stream", ORACLES["split_poison"])
def q_split_poison_stream(spark, sf_dir):
    src = _records(spark, sf_dir, "tasks", "id", "value", "tasks", 3)
    good, bad, ck = scratch_dir(spark, "good"), scratch_dir(spark, "bad"), scratch_dir(spark, "ck")
    jobs.split_poison_stream(jobs.read_records(spark, path=src, max_files_per_trigger=1), good, bad, ck)
    g = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(True))
    b = spark.read.parquet(bad).agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(False))
    return g.unionByName(b).where(F.col("n") > 0)


@query("exactly_once_effect", with_views(["tasks"], """
SELECT id AS key, value FROM tasks WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE FALSE END
"""))
def q_exactly_once_effect(spark, sf_dir):
    src = scratch_dir(spark, "in-dup")
    tasks = view(spark, sf_dir, "tasks")
    # Every message is delivered twice, and the job runs twice on one checkpoint.
    jobs.write_records(tasks, src, "id", "value", "tasks", 2)
    jobs.write_records(tasks, src, "id", "value", "tasks", 2)
    table, ck = scratch_dir(spark, "table"), scratch_dir(spark, "ck")
    for _ in range(2):
        jobs.upsert_stream(jobs.read_records(spark, path=src, max_files_per_trigger=1), table, ck)
    return jobs.read_latest(spark, table, ["key"]).select(F.col("key").cast("bigint").alias("key"), "value")


@query("link_stream", with_views(["link_candidates", "links_existing"], """
SELECT id, url, url_normalized, sha256(url_normalized) AS url_hash FROM st WHERE status = 'new'
""", norm=_URL_NORM, st=_STATUS))
def q_link_stream(spark, sf_dir):
    src = _records(spark, sf_dir, "link_candidates", "id", "url", "links", 1, offset="id")
    history, published, ck = scratch_dir(spark, "links"), scratch_dir(spark, "pub"), scratch_dir(spark, "ck")
    existing = view(spark, sf_dir, "links_existing")
    # The links known before the stream starts, as history batch -1.
    existing.select(F.col("id").cast("long"), F.col("url_normalized").alias("url"), "url_normalized",
                    F.sha2("url_normalized", 256).alias("url_hash")).write.parquet(f"{history}/batch_id=-1")
    jobs.link_stream(jobs.read_records(spark, path=src), history, published, ck)
    return spark.read.parquet(published).select("id", "url", "url_normalized", "url_hash")


@query("running_app_stats", with_views(["events_mon"], _STATS_SQL))
def q_running_app_stats(spark, sf_dir):
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs.running_app_stats(_requests_stream(spark, sf_dir, max_files=1), out, ck)
    return sinks.read_current(spark, out)


@query("snapshots_stream", ORACLES["snapshots"])
def q_snapshots_stream(spark, sf_dir):
    table, ck = scratch_dir(spark, "snap"), scratch_dir(spark, "ck")
    jobs.snapshot_stream(_requests_stream(spark, sf_dir), table, ck)
    return jobs.with_running_peak(jobs.read_latest(spark, table, ["app_name", "captured_at"]))


@query("alert_stream", with_views(["events_mon"], _ALERTS_SQL))
def q_alert_stream(spark, sf_dir):
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs.alert_stream(_requests_stream(spark, sf_dir, max_files=1), out, ck)
    return spark.read.parquet(out)


@query("heavy_only_stream", with_views(["events_mon"], "SELECT * FROM events_mon WHERE rss_delta_mb >= 1.0"))
def q_heavy_only_stream(spark, sf_dir):
    out, ck = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    jobs.heavy_stream(_requests_stream(spark, sf_dir, max_files=1), out, ck)
    return spark.read.parquet(out)


def _flaky_handler(df):
    """Test handler: keys divisible by 11 always fail, keys divisible by 7
    fail on their first attempt only."""
    k = F.col("key").cast("long")
    err = (F.when(k % 11 == 0, F.lit("always failing"))
           .when((k % 7 == 0) & (F.col("attempt") == 1), F.lit("transient")))
    return df.withColumn("error", err)


@query("retry_then_dlq", with_views(["tasks"], """
SELECT id AS key, CASE WHEN id % 11 = 0 THEN 'dlq' ELSE 'ok' END AS status,
  CASE WHEN id % 11 = 0 THEN 6 WHEN id % 7 = 0 THEN 2 ELSE 1 END AS attempts
FROM tasks WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE FALSE END
"""))
def q_retry_then_dlq(spark, sf_dir):
    src = _records(spark, sf_dir, "tasks", "id", "value", "tasks", 4)
    # Empty record files: later micro-batches that only carry due retries.
    for _ in range(6):
        spark.createDataFrame([], jobs.RECORD_SCHEMA).coalesce(1).write.mode("append").json(src)
    out, retry, dlq, bad, ck = (scratch_dir(spark, p) for p in ("ok", "retry", "dlq", "bad", "ck"))
    jobs.retry_then_dlq(jobs.read_records(spark, path=src, max_files_per_trigger=1), _flaky_handler, out, retry, dlq,
                        bad, ck, clock=lambda b: b * 1000.0)
    ok = spark.read.schema("key string, value string, attempt int").parquet(out) \
        .select("key", F.lit("ok").alias("status"), F.col("attempt").alias("attempts"))
    dead = spark.read.schema("key string, value string, attempt int, error string").parquet(dlq) \
        .select("key", F.lit("dlq").alias("status"), F.col("attempt").alias("attempts"))
    return ok.unionByName(dead).withColumn("key", F.col("key").cast("bigint"))
