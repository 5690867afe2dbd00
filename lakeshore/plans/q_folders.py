"""Query bindings: folder processing (J4) and its stream stages.
The raw folders hold ``li_trade_parts`` split into three folders of the
entity ``TRADE``; the oracle is the control-sum SQL per folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeshore.operators.folders import process_folders
from lakeshore.plans.control_sql import control_sum_ctes
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir
from lakeshore.streaming import jobs

ALLOWED = ["TRADE"]
CONFIG = {"TRADE": ["dataset_checksum"]}
FOLDERS = {0: "TRADE/2024-01-01/202401", 1: "TRADE/2024-01-02/202401", 2: "TRADE/2024-01-03/202401"}


TASKS = {0: "t0", 1: "t1", 2: "t2"}
_PARTS = """
SELECT *, concat('t', CAST(part_no AS STRING)) AS task_id FROM li_trade_parts
"""


def _sums(where: str) -> str:
    return with_views(["li_trade_parts"], "SELECT * FROM sums", parts=_PARTS,
                      **control_sum_ctes("parts", where, "task_id, dataset_checksum"))


def _raw_tree(spark, sf_dir, parts=(0, 1, 2)):
    root = scratch_dir(spark, "raw")
    li = view(spark, sf_dir, "li_trade_parts")
    for p in parts:
        li.where(F.col("part_no") == p).drop("part_no").write.parquet(f"{root}/{FOLDERS[p]}")
    return root


@query("process_folder", _sums("TRUE"))
def q_process_folder(spark, sf_dir):
    root = _raw_tree(spark, sf_dir)
    tasks = spark.createDataFrame([(TASKS[p], f, None) for p, f in FOLDERS.items()],
                                  "task_id string, folder string, split_columns array<string>")
    res, sums = process_folders(spark, tasks, root, scratch_dir(spark, "temp"), ALLOWED, CONFIG)
    return sums.select("task_id", "dataset_checksum", "control_sum", "row_count")


_MESSAGES = [
    {"task_id": "t0", "entity": "TRADE", "folder_path": FOLDERS[0], "split_columns": ["dataset_checksum"],
     "download_result": {"status": "completed"}},
    {"task_id": "t1", "entity": "TRADE", "folder_path": FOLDERS[1], "download_result": {"status": "error"}},
    {"task_id": "t2", "entity": "TRADE", "folder_path": FOLDERS[2], "download_result": {"status": "completed"}},
    {"task_id": "t3", "entity": "OTHER", "folder_path": "OTHER/2024-01-01/202401", "download_result": {"status": "completed"}},
    {"task_id": "t4", "entity": "TRADE", "folder_path": "TRADE/2099-01-01/209901", "split_column": "dataset_checksum",
     "download_result": {"status": "completed"}},
]


def _run_stage(spark, sf_dir, verification):
    root = _raw_tree(spark, sf_dir)
    src = scratch_dir(spark, "in-verify")
    msgs = spark.createDataFrame([(m["task_id"], json.dumps(m)) for m in _MESSAGES], "id string, value string")
    msgs.select(F.col("id").alias("key"), "value", F.lit("verification").alias("topic"),
                F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset")).coalesce(1).write.json(src)
    res, sums, ck = scratch_dir(spark, "res"), scratch_dir(spark, "sums"), scratch_dir(spark, "ck")
    jobs.folder_stage(jobs.read_records(spark, path=src), root, scratch_dir(spark, "temp"), ALLOWED, CONFIG,
                      res, sums, ck, verification=verification)
    return spark.read.parquet(res), spark.read.parquet(sums)


@query("verification_stage", _sums("part_no IN (0, 2)"))
def q_verification_stage(spark, sf_dir):
    _, sums = _run_stage(spark, sf_dir, True)
    return sums.select("task_id", "dataset_checksum", "control_sum", "row_count")


@query("process_folder_stage", with_views(["li_trade_parts"], """
SELECT 't0' AS task_id, 'completed' AS status, count(*) AS total_rows FROM li_trade_parts WHERE part_no = 0
UNION ALL SELECT 't1', 'completed', count(*) FROM li_trade_parts WHERE part_no = 1
UNION ALL SELECT 't2', 'completed', count(*) FROM li_trade_parts WHERE part_no = 2
UNION ALL SELECT 't3', 'error', 0
UNION ALL SELECT 't4', 'error', 0
"""))
def q_process_folder_stage(spark, sf_dir):
    res, _ = _run_stage(spark, sf_dir, False)
    return res.select("task_id", "status", "total_rows")
