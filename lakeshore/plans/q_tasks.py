"""Query bindings: task messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.functions.core import body_preview
from lakeshore.operators import tasks as tk
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views

# Per-entity split columns of the test configuration.
SPLIT_CONFIG = [("E0", ["dataset_checksum"]), ("E1", ["k1", "", "k2"]), ("E2", [])]


def _items(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").where(F.expr("try_parse_json(value) IS NOT NULL"))
    return t.select("id", F.from_json("value", "entity string, updated_at string, period string, links array<string>")
                    .alias("i")).select("id", "i.*")


@query("build_tasks", with_views(["tasks"], """
SELECT id, concat_ws('/', e, u, p) AS dest_path, e AS entity, u AS updated_at, p AS period, n AS n_urls
FROM (SELECT id, json_extract_string(value, '$.entity') AS e, json_extract_string(value, '$.updated_at') AS u,
             json_extract_string(value, '$.period') AS p, json_array_length(value, '$.links') AS n
      FROM tasks WHERE json_valid(value))
WHERE n > 0
"""))
def q_build_tasks(spark, sf_dir):
    # The task_id is a fresh UUID per message, so the binding compares the rest.
    msgs = tk.build_tasks(_items(spark, sf_dir), "new", keep=("id",))
    return msgs.select("id", "dest_path", "entity", "updated_at", "period", F.size("urls").alias("n_urls"))


@query("split_poison", with_views(["tasks"], """
SELECT CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE FALSE END AS good, count(*) AS n FROM tasks GROUP BY 1
"""))
def q_split_poison(spark, sf_dir):
    good, bad = tk.split_poison(view(spark, sf_dir, "tasks"))
    return (good.agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(True))
            .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).withColumn("good", F.lit(False)))
            .where(F.col("n") > 0))


_NORM = """
SELECT id, poison,
  CASE WHEN old THEN coalesce(parts[1], e, '') ELSE coalesce(parts[1], e, '') END AS entity,
  coalesce(parts[2], u, '') AS updated_at, coalesce(parts[3], p, '') AS period,
  len(urls) AS n_urls, urls[1] AS first_url
FROM (
  SELECT id, old, e, u, p, list_filter(string_split(rel, '/'), lambda x: x <> '') AS parts, urls,
    NOT json_valid(value) OR (NOT old AND len(urls) = 0) AS poison
  FROM (
    SELECT id, value, old, e, u, p,
      CASE WHEN old THEN rp ELSE regexp_replace(coalesce(dp, ''), '^/+|/+$', '', 'g') END AS rel,
      CASE WHEN old THEN CASE WHEN json_type(value, '$.url') = 'ARRAY' THEN CAST(json_extract(value, '$.url') AS VARCHAR[])
                              ELSE [json_extract_string(value, '$.url')] END
           ELSE coalesce(CAST(json_extract(value, '$.urls') AS VARCHAR[]), []) END AS urls
    FROM (
      SELECT id, value, json_valid(value) AND json_extract(value, '$.url') IS NOT NULL
                                          AND json_extract(value, '$.relative_path') IS NOT NULL AS old,
        json_extract_string(value, '$.entity') AS e, json_extract_string(value, '$.updated_at') AS u,
        json_extract_string(value, '$.period') AS p, json_extract_string(value, '$.relative_path') AS rp,
        json_extract_string(value, '$.dest_path') AS dp
      FROM download_msgs WHERE json_valid(value))))
UNION ALL
SELECT id, TRUE AS poison, '' AS entity, '' AS updated_at, '' AS period, 0 AS n_urls, NULL AS first_url
FROM download_msgs WHERE NOT json_valid(value)
"""


@query("normalize_task", with_views(["download_msgs"], "SELECT * FROM norm", norm=_NORM))
def q_normalize_task(spark, sf_dir):
    n = tk.normalize_download_task(view(spark, sf_dir, "download_msgs"))
    return n.select("id", "poison", "entity", "updated_at", "period", F.size("urls").alias("n_urls"),
                    F.try_element_at("urls", F.lit(1)).alias("first_url"))


_CFG_SQL = "(VALUES ('E0', 'dataset_checksum'), ('E1', 'k1,k2'), ('E2', '')) AS cfg(entity, cols)"


@query("resolve_split_columns", with_views(["download_msgs"], f"""
SELECT n.id, CASE
    WHEN json_type(m.value, '$.split_columns') = 'ARRAY' AND json_array_length(m.value, '$.split_columns') > 0 THEN
      array_to_string(list_filter(list_transform(CAST(json_extract(m.value, '$.split_columns') AS JSON[]),
        lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END), lambda x: x IS NOT NULL AND x <> ''), ',')
    WHEN json_type(m.value, '$.split_columns') = 'VARCHAR' AND json_extract_string(m.value, '$.split_columns') <> ''
      THEN json_extract_string(m.value, '$.split_columns')
    WHEN json_extract_string(m.value, '$.split_column') <> '' THEN json_extract_string(m.value, '$.split_column')
    ELSE coalesce((SELECT cols FROM {_CFG_SQL} WHERE cfg.entity = n.entity), '') END AS split_columns
FROM norm n JOIN download_msgs m ON m.id = n.id WHERE NOT n.poison
""", norm=_NORM))
def q_resolve_split_columns(spark, sf_dir):
    n = tk.normalize_download_task(view(spark, sf_dir, "download_msgs")).where(~F.col("poison"))
    cfg = spark.createDataFrame(SPLIT_CONFIG, "entity string, split_columns array<string>")
    r = tk.resolve_split_columns(n.drop("split_columns"), cfg)
    return r.select("id", F.array_join("split_columns", ",").alias("split_columns"))


@query("consumer_lag", with_views(["offsets"], """
SELECT c.topic, c.part, c.committed AS current_offset, coalesce(e.end_offset, 0) AS end_offset,
  greatest(0, coalesce(e.end_offset, 0) - c.committed) AS lag
FROM offsets c LEFT JOIN (SELECT topic, part, end_offset FROM offsets WHERE part <> 1) e USING (topic, part)
WHERE c.committed IS NOT NULL AND NOT starts_with(c.topic, '__')
"""))
def q_consumer_lag(spark, sf_dir):
    o = view(spark, sf_dir, "offsets")
    return tk.consumer_lag(o.select("topic", "part", "committed"),
                           o.where(F.col("part") != 1).select("topic", "part", "end_offset"))


_FILES = """
SELECT l_orderkey AS task_id, l_linestatus = 'F' AS ok, CAST(l_quantity * 1000 AS BIGINT) AS size,
  concat('/dl/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '.parquet') AS path,
  CASE WHEN l_linestatus <> 'F' THEN concat('timeout ', CAST(l_linenumber AS STRING)) END AS error,
  CAST(l_linenumber * 7 AS DOUBLE) AS started, CAST(l_linenumber * 7 + l_quantity AS DOUBLE) AS finished
FROM lineitem
"""


@query("download_result", with_views([], """
SELECT task_id, count(*) FILTER (WHERE ok) AS files_downloaded,
  greatest(0, count(*) - count(*) FILTER (WHERE ok)) AS files_failed,
  sum(CASE WHEN ok THEN size ELSE 0 END) AS total_size_bytes, max(finished) - min(started) AS duration_sec,
  coalesce(array_to_string(list_sort(list(path) FILTER (WHERE ok)), ','), '') AS file_paths,
  coalesce(array_to_string(list_sort(list(error) FILTER (WHERE error IS NOT NULL)), ','), '') AS errors,
  CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'completed' ELSE 'error' END AS status
FROM files GROUP BY task_id
""", files=_FILES))
def q_download_result(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    r = tk.download_result(spark.sql(_FILES))
    return r.withColumn("file_paths", F.array_join("file_paths", ",")).withColumn("errors", F.array_join("errors", ","))


_CHANGES = """
SELECT conv_id AS task_id, turn AS seq, turn AS changed_at,
  CASE role WHEN 'assistant' THEN 'sent' WHEN 'user' THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN role <> 'assistant' THEN text END AS error
FROM conversations
"""


@query("latest_status", with_views([], """
SELECT task_id, status, sent_at, CASE WHEN status = 'sent' THEN NULL ELSE error END AS error_message, changes
FROM (SELECT task_id, arg_max(status, seq) AS status, arg_max(error, seq) AS error,
             max(CASE WHEN status = 'sent' THEN changed_at END) AS sent_at, count(*) AS changes
      FROM changes GROUP BY task_id)
""", changes=_CHANGES))
def q_latest_status(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    return tk.latest_status(spark.sql(_CHANGES), at="changed_at")


@query("with_dlq", """
SELECT DISTINCT event_type AS topic FROM events UNION ALL SELECT DISTINCT concat(event_type, '.dlq') AS topic FROM events
""")
def q_with_dlq(spark, sf_dir):
    return tk.with_dlq(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


@query("body_preview", "SELECT conv_id, turn, substr(text, 1, 500) AS preview FROM conversations")
def q_body_preview(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", body_preview("text").alias("preview"))


_REPORT_IN = """
SELECT o_orderkey AS task_id, concat('E', CAST(o_custkey % 5 AS STRING)) AS entity, '202401' AS period,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS updated_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'error' ELSE 'completed' END AS download_status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'skipped' WHEN '3' THEN 'error' ELSE 'completed' END
    AS processing_status,
  CAST(o_orderkey % 7 AS BIGINT) AS files_downloaded, CAST(o_orderkey % 3 AS BIGINT) AS files_failed,
  CAST(o_totalprice * 100 AS BIGINT) AS total_size_bytes, CAST(o_custkey AS BIGINT) AS total_rows,
  o_orderdate AS started_at, o_orderdate + INTERVAL 90 SECOND AS finished_at
FROM orders
"""


@query("ingest_report", with_views([], """
SELECT task_id, entity,
  CASE WHEN download_status = 'completed' AND processing_status = 'completed' THEN 'completed'
       WHEN download_status = 'error' OR processing_status = 'error' THEN 'failed' ELSE 'partial' END AS pipeline_status,
  download_status, processing_status, 90.0 AS duration_sec, 1 AS report_version
FROM inp
""", inp=_REPORT_IN))
def q_ingest_report(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    r = tk.ingest_report(spark.sql(_REPORT_IN))
    return r.select(F.col("report.task_id").cast("bigint").alias("task_id"), "report.entity", "report.pipeline_status",
                    F.col("report.download.status").alias("download_status"),
                    F.col("report.processing.status").alias("processing_status"),
                    "report.duration_sec", "report.report_version")
