"""Folder processing: split + control sums for the folders named by tasks
(J4, and the verification / process-folder stages S5, S7).

All tasks that share a split-column list and a schema are processed by one
Spark job: their folders are read together, each file is mapped to every task
whose folder holds it (an equi join on the file's ancestors), the split is partitioned by
(task, keys) and the control sums are grouped by (task, checksum).  The
task list of a micro-batch is a handful of control rows; it is the data
behind them that Spark distributes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions.paths import ancestors
from lakeshore.operators import split as sp
from lakeshore.sources import sinks

RESULT_SCHEMA = ("task_id string, folder string, status string, split_performed boolean, total_rows long, "
                 "dropped_rows long, groups long, error string")


def _control_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """D3 per (keys..., dataset_checksum)."""
    k = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys + ["dataset_checksum"]])
    s = sp.control_sum(df.withColumn("_ck", k), key="_ck")
    parts = F.split("_ck", "\u0001")
    return s.select(*[parts[i].alias(c) for i, c in enumerate(keys + ["dataset_checksum"])], "control_sum", "row_count")


def process_folders(spark: SparkSession, tasks: DataFrame, raw_root: str, temp_root: str,
                    allowed_entities: list[str], config: dict[str, list[str]] | None = None,
                    max_records: int | None = None, no_split: str = "error") -> tuple[DataFrame, DataFrame]:
    """J4 for many tasks.  ``tasks``: task_id, folder (relative to
    ``raw_root``), split_columns array<string> (may be empty), optional
    download_status.  Returns (results per task, control sums per task and
    checksum).  ``no_split``: status for a task without split columns
    ("error" for J4, "completed" for the verification stage)."""
    config = config or {}
    raw_root = raw_root.rstrip("/")
    rows = tasks.select("task_id", "folder", "split_columns",
                        (F.col("download_status") if "download_status" in tasks.columns
                         else F.lit(None).cast("string")).alias("dl")).collect()
    results, groups = [], {}
    for r in rows:
        folder = (r.folder or "").strip().strip("/")
        entity = folder.split("/")[0] if folder else ""
        cols = [c for c in (r.split_columns or []) if isinstance(c, str) and c.strip()]
        if not cols:
            cols = [c for c in config.get(entity, []) if c and c.strip()]
        if r.dl == "error":
            results.append(_row(r.task_id, folder, "skipped"))
        elif r.dl == "empty":
            results.append(_row(r.task_id, folder, "completed"))
        elif not folder:
            results.append(_row(r.task_id, folder, "error", error="empty folder path"))
        elif entity not in allowed_entities:
            results.append(_row(r.task_id, folder, "error", error=f"entity not allowed: {entity}"))
        elif not cols:
            results.append(_row(r.task_id, folder, no_split, error="no split columns" if no_split == "error" else None))
        elif not sinks.exists(spark, f"{raw_root}/{folder}"):
            results.append(_row(r.task_id, folder, "error", error=f"folder not found: {folder}"))
        else:
            groups.setdefault(tuple(cols), []).append((r.task_id, folder))
    sums = []
    for cols, members in groups.items():
        # Folders are read together only when their schemas agree, so no
        # column is lost; a folder that cannot be read fails by itself.
        by_schema = {}
        for task_id, folder in members:
            path = f"{raw_root}/{folder}"
            if not _has_files(spark, path):
                results.append(_row(task_id, folder, "empty"))
                continue
            try:
                schema = _read(spark, [path]).schema
            except AnalysisException as e:
                results.append(_row(task_id, folder, "error", error=f"unreadable folder: {e.getCondition()}"))
                continue
            by_schema.setdefault(schema.json(), []).append((task_id, folder))
        for same in by_schema.values():
            res, sm = _process_group(spark, same, list(cols), raw_root, temp_root, max_records)
            results.extend(res)
            if sm is not None:
                sums.append(sm)
    out = spark.createDataFrame(results, RESULT_SCHEMA) if results else spark.createDataFrame([], RESULT_SCHEMA)
    sum_schema = "task_id string, dataset_checksum string, control_sum double, row_count long"
    all_sums = reduce(DataFrame.unionByName, sums) if sums else spark.createDataFrame([], sum_schema)
    return out, all_sums


#: Data files of a folder: parquet, also after the transfer has marked it.
DATA_FILES = "*.{parquet,parquet.sended}"


def _has_files(spark, path) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", DATA_FILES).load(path)
    return not files.select("path").isEmpty()


def _read(spark, paths):
    """The data files below ``paths``; files of one folder may differ in
    columns, so their schemas are merged."""
    return (spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
            .option("pathGlobFilter", DATA_FILES).parquet(*paths))


def _process_group(spark, members, cols, raw_root, temp_root, max_records):
    root = _strip(raw_root)
    paths = _outermost(f"{root}/{f}" for _, f in members)
    data = _read(spark, paths).withColumn("_path", _local(F.col("_metadata.file_path")))
    missing = [c for c in cols if c not in data.columns]
    if missing:
        return [_row(t, f, "error", error=f"split columns not in data: {missing}") for t, f in members], None
    # Each folder is read once however many tasks name it.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", DATA_FILES).load(paths)
    files = listed.select(_local(F.col("path")).alias("_path"))
    tasks = spark.createDataFrame([(f"{root}/{f}", t) for t, f in members], "_folder string, _task string")
    tagged = _with_tasks(data, files, tasks)
    keep = reduce(lambda a, b: a & b, [sp.not_blank(F.col(c)) for c in cols])
    dropped = {r["_task"]: r["n"] for r in tagged.groupBy("_task").agg(F.count_if(~keep).alias("n")).collect()}
    target = f"{temp_root.rstrip('/')}/{uuid.uuid4().hex}"
    if max_records is None:
        max_records = sp.rows_per_file(data)
    # The task names a folder of the result and is not part of the user's rows.
    res = sp.split_by_columns(tagged, target, ["_task"] + cols, max_records=max_records, folder_only=("_task",))
    stats = {r["_task"]: r for r in res.stats.groupBy("_task")
             .agg(F.sum("rows").alias("total_rows"), F.count(F.lit(1)).alias("groups")).collect()}
    written = sp.read_split(spark, target, ("_task",))
    sums = None
    if "dataset_checksum" in written.columns:
        sums = _control_sums(written, ["_task"]).withColumnRenamed("_task", "task_id")
    out = []
    for t, f in members:
        s = stats.get(t)
        if s is None and not dropped.get(t):
            out.append(_row(t, f, "empty"))
        else:
            out.append(_row(t, f, "completed", split_performed=True, total_rows=int(s["total_rows"]) if s else 0,
                            dropped_rows=int(dropped.get(t, 0)), groups=int(s["groups"]) if s else 0))
    return out, sums


def _with_tasks(data, files, tasks):
    """``data`` with the task of its file: a file belongs to every task whose
    folder holds it, directly or deeper down.  The side that travels is named
    here: a listing is estimated by the bytes of its files, so Spark would take
    the data, whose columns are small on disk, for the smaller side and send
    that through the driver.  ``files`` has one row per file."""
    owner = files.select("_path", F.explode(ancestors(F.col("_path"))).alias("_folder")).join(F.broadcast(tasks), "_folder")
    return data.join(F.broadcast(owner.select("_path", "_task")), "_path").drop("_path")


def _outermost(paths) -> list[str]:
    """Distinct folders that lie in no other of them."""
    out: list[str] = []
    for p in sorted({x.rstrip("/") for x in paths}, key=lambda x: x + "/"):
        if not out or not (p + "/").startswith(out[-1] + "/"):
            out.append(p)
    return out


def _row(task_id, folder, status, split_performed=False, total_rows=0, dropped_rows=0, groups=0, error=None):
    return dict(task_id=task_id, folder=folder, status=status, split_performed=split_performed, total_rows=total_rows,
                dropped_rows=dropped_rows, groups=groups, error=error)


def _local(c):
    return F.regexp_replace(c, r"^file:(//)?", "")


def _strip(p: str) -> str:
    import re
    return re.sub(r"^file:(//)?", "", p)
