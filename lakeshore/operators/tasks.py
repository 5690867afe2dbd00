"""Download/verification task messages as DataFrames (A15, C9, C10, D13,
E2, G3, H27, S1, S2, S6).  A message is a row with a JSON ``value``; the
same functions run on a batch table or inside a stream's micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.operators.common import spread_for_cpu

TASK_SCHEMA = ("task_id string, urls array<string>, url string, dest_path string, relative_path string, "
               "entity string, updated_at string, period string, split_columns string, split_column string")


def _nonblank_join(parts: list[Column], empty: str = ".") -> Column:
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(arr) > 0, F.array_join(arr, "/")).otherwise(F.lit(empty))


def build_tasks(items: DataFrame, layout: str = "new", keep: tuple[str, ...] = ()) -> DataFrame:
    """Items {entity, updated_at, period, links} -> task messages; items
    without links are skipped; the message key is the task_id (new layout)
    or the entity (old layout).  ``keep`` columns pass through."""
    it = items.where(F.col("links").isNotNull() & (F.size("links") > 0))
    e, u, p = [F.coalesce(F.col(c), F.lit("")) for c in ("entity", "updated_at", "period")]
    path = _nonblank_join([e, u, p])
    if layout == "new":
        msgs = it.select(*keep, F.expr("uuid()").alias("task_id"), F.col("links").alias("urls"),
                         path.alias("dest_path"), e.alias("entity"), u.alias("updated_at"), p.alias("period"))
        return msgs.withColumn("key", F.col("task_id"))
    return it.select(*keep, F.col("links").alias("url"), path.alias("relative_path"), e.alias("entity"),
                     u.alias("updated_at"), p.alias("period"), e.alias("key"))


def split_poison(messages: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages that are not JSON objects go to the bad output."""
    v = F.try_parse_json(F.col(value_col))
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return messages.where(ok), messages.where(~ok | ok.isNull())


def normalize_download_task(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Both task layouts -> task_id, entity, updated_at, period, urls,
    plus ``poison`` (new layout without URLs, or not a JSON object).
    Parts of the path beat the explicit fields; a single URL becomes a list;
    a missing task_id gets a UUID."""
    messages = spread_for_cpu(messages)
    v = F.try_parse_json(F.col(value_col))
    get = lambda path, t="string": F.try_variant_get(v, path, t)
    old = get("$.url").isNotNull() & get("$.relative_path").isNotNull()
    url_list = F.coalesce(get("$.url", "array<string>"), F.array(get("$.url")))
    rel = F.when(old, get("$.relative_path")).otherwise(F.regexp_replace(F.coalesce(get("$.dest_path"), F.lit("")),
                                                                          "^/+|/+$", ""))
    parts = F.filter(F.split(rel, "/"), lambda x: x != "")
    part = lambda i, name: F.coalesce(F.try_element_at(parts, F.lit(i)), get(f"$.{name}"), F.lit(""))
    urls = F.when(old, url_list).otherwise(F.coalesce(get("$.urls", "array<string>"), F.array().cast("array<string>")))
    poison = v.isNull() | (~old & (F.size(urls) == 0))
    return messages.select(
        "*", F.coalesce(get("$.task_id"), F.expr("uuid()")).alias("task_id"),
        part(1, "entity").alias("entity"), part(2, "updated_at").alias("updated_at"),
        part(3, "period").alias("period"), urls.alias("urls"), poison.alias("poison"))


def resolve_split_columns(tasks: DataFrame, config: DataFrame, value_col: str = "value") -> DataFrame:
    """Message list -> message string -> per-entity config; non-string
    or blank entries dropped.  ``config`` has (entity, split_columns
    array<string>) and is broadcast (one row per configured entity)."""
    v = F.try_parse_json(F.col(value_col))
    as_list = F.try_variant_get(v, "$.split_columns", "array<variant>")
    strings = F.filter(F.transform(as_list, lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                              F.try_variant_get(x, "$", "string"))),
                       lambda x: x.isNotNull() & (x != ""))
    single = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.split_columns", "variant")) == "STRING",
                               F.try_variant_get(v, "$.split_columns", "string")),
                        F.try_variant_get(v, "$.split_column", "string"))
    cfg = config.select(F.col("entity").alias("_cfg_entity"), F.col("split_columns").alias("_cfg_cols"))
    j = tasks.join(cfg, F.col("entity") == F.col("_cfg_entity"), "left")
    cols = (F.when(as_list.isNotNull() & (F.size(as_list) > 0), strings)
            .when(single.isNotNull() & (single != ""), F.array(single))
            .otherwise(F.coalesce(F.filter(F.col("_cfg_cols"), lambda x: x.isNotNull() & (x != "")),
                                  F.array().cast("array<string>"))))
    return j.withColumn("split_columns", cols).drop("_cfg_entity", "_cfg_cols")


def consumer_lag(committed: DataFrame, end_offsets: DataFrame) -> DataFrame:
    """Per topic partition max(0, end - committed); partitions without
    a commit are dropped, a missing end offset counts 0, internal topics
    (``__*``) are ignored."""
    c = committed.where(F.col("committed").isNotNull() & ~F.col("topic").startswith("__"))
    j = c.join(end_offsets, ["topic", "part"], "left")
    end = F.coalesce(F.col("end_offset"), F.lit(0))
    return j.select("topic", "part", F.col("committed").alias("current_offset"), end.alias("end_offset"),
                    F.greatest(F.lit(0), end - F.col("committed")).alias("lag"))


def download_result(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Per task files moved, failed = max(0, requested - moved), bytes,
    duration, sorted paths and errors.  Paths and errors are per task (a
    task names its own files), never global lists."""
    g = files.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("ok")).alias("files_downloaded"),
        F.sum(F.when(F.col("ok"), F.col("size")).otherwise(F.lit(0))).alias("total_size_bytes"),
        F.max("finished").alias("_end"), F.min("started").alias("_start"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("path")))).alias("file_paths"),
        F.sort_array(F.collect_list(F.col("error"))).alias("errors"))
    return g.select("task_id", "files_downloaded",
                    F.greatest(F.lit(0), F.col("requested") - F.col("files_downloaded")).alias("files_failed"),
                    "total_size_bytes", (F.col("_end") - F.col("_start")).alias("duration_sec"),
                    "file_paths", "errors",
                    F.when(F.col("files_downloaded") > 0, F.lit("completed")).otherwise(F.lit("error")).alias("status"))


def latest_status(changes: DataFrame, key: str = "task_id", seq: str = "seq", at: str = "at") -> DataFrame:
    """Current state per task from its change log: the last status;
    ``sent`` sets the sent time and clears the error, other changes set the
    error they carry.  One aggregate (max_by), so a task with many changes
    is combined map-side."""
    last = F.max_by(F.struct("status", "error"), F.col(seq))
    sent_at = F.max(F.when(F.col("status") == "sent", F.col(at)))
    g = changes.groupBy(key).agg(last.alias("_l"), sent_at.alias("sent_at"), F.count(F.lit(1)).alias("changes"))
    return g.select(key, F.col("_l.status").alias("status"), "sent_at",
                    F.when(F.col("_l.status") == "sent", F.lit(None).cast("string"))
                    .otherwise(F.col("_l.error")).alias("error_message"), "changes")


def with_dlq(topics: DataFrame, col: str = "topic") -> DataFrame:
    """Every topic and its dead-letter topic ``<topic>.dlq``."""
    t = topics.select(F.col(col).alias("topic")).distinct()
    return t.unionByName(t.select(F.concat("topic", F.lit(".dlq")).alias("topic")))


def ingest_report(tasks: DataFrame, source_topic: str = "report") -> DataFrame:
    """The nested report per task: completed when both stages
    completed, failed when either has an error, otherwise partial."""
    dl, pr = F.col("download_status"), F.col("processing_status")
    status = (F.when((dl == "completed") & (pr == "completed"), F.lit("completed"))
              .when((dl == "error") | (pr == "error"), F.lit("failed")).otherwise(F.lit("partial")))
    download = F.struct(dl.alias("status"), F.col("files_downloaded"), F.col("files_failed"),
                        F.col("total_size_bytes"))
    processing = F.struct(pr.alias("status"), (pr == "completed").alias("split_performed"),
                          F.col("total_rows"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    duration = (micros("finished_at") - micros("started_at")) / F.lit(1e6)
    report = F.struct(F.col("task_id").cast("string").alias("task_id"), "entity", "period", "updated_at",
                      status.alias("pipeline_status"), download.alias("download"), processing.alias("processing"),
                      F.col("started_at").cast("string").alias("started_at"),
                      F.col("finished_at").cast("string").alias("finished_at"),
                      duration.alias("duration_sec"), F.lit(1).alias("report_version"),
                      F.lit(source_topic).alias("source_topic"))
    return tasks.select(report.alias("report"), F.to_json(report).alias("value"))
