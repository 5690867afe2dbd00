"""Composite jobs and streams: registry scan (J1-J3), folder processing
(J4), and the stream bindings' exactly-once and retry behaviour."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeshore.operators import folders, scan


def test_scan_registry_facts(spark, sf):
    rows = entry.queries()["refresh_scan"](spark, sf).collect()
    active = [r for r in rows if r.is_active]
    gone = [r for r in rows if not r.is_active]
    assert len(gone) == 1 and gone[0].period == "202312"
    for r in active:
        v = json.loads(r.validation)
        if r.link.endswith(".parquet"):
            assert v["row_count"] == spark.read.parquet(r.link).count()
        if r.name == "src0":
            combos = spark.read.parquet(r.link).select("k1", "k2").distinct().count()
            assert v["split_combinations_count"] == combos
        if r.name == "src1":
            assert sorted(v["distinct_values"]) == ["k2", "l_linenumber"]
    bad_date = [r for r in active if "2024-13-40" in r.link]
    assert bad_date and bad_date[0].upload_date is None and bad_date[0].period == "202401"


def test_register_files_explicit_values(spark, sf):
    rows = entry.queries()["register_files"](spark, sf).collect()
    assert all(r.name == "src0" and r.period == "209912" for r in rows)


def test_source_rule():
    assert scan.source_rule({"processing": {"split_columns": ["a"]}}) == ("combinations", ["a"])
    assert scan.source_rule({"split_columns": "a"}) == ("combinations", ["a"])
    assert scan.source_rule({"distinct_fields": ["x"]}) == ("values", ["x"])
    assert scan.source_rule(["y", "z"]) == ("values", ["y", "z"])
    assert scan.source_rule({}) == ("none", [])


def test_exactly_once_stream(spark, sf):
    df = entry.queries()["exactly_once_effect"](spark, sf)
    assert df.count() == df.select("key").distinct().count()


def test_retry_dlq_stream(spark, sf):
    df = entry.queries()["retry_then_dlq"](spark, sf)
    got = {r.key: (r.status, r.attempts) for r in df.collect()}
    for k, (status, attempts) in got.items():
        if k % 11 == 0:
            assert (status, attempts) == ("dlq", 6)
        elif k % 7 == 0:
            assert (status, attempts) == ("ok", 2)
        else:
            assert (status, attempts) == ("ok", 1)


def test_process_folder_stage_statuses(spark, sf):
    got = {r.task_id: r.status for r in entry.queries()["process_folder_stage"](spark, sf).collect()}
    assert got == {"t0": "completed", "t1": "completed", "t2": "completed", "t3": "error", "t4": "error"}


def test_process_folder_never_broadcasts_the_data(spark, tmp_path):
    """The listing is estimated by the bytes of its files; the data must stay where it is read."""
    root = str(tmp_path)
    spark.range(1000).selectExpr("id", "repeat(uuid(), 20) AS v").write.parquet(f"{root}/E/a")
    data = folders._read(spark, [root]).withColumn("_path", folders._local(F.col("_metadata.file_path")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", folders.DATA_FILES).load(root).select(folders._local(F.col("path")).alias("_path"))
    tasks = spark.createDataFrame([(f"{root}/E", "t0"), (f"{root}/E/a", "t1")], "_folder string, _task string")
    tagged = folders._with_tasks(data, files, tasks).select("id", "_task")
    plan = tagged._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and plan.index("Scan parquet") < plan.index("Scan binaryFile") and "BuildLeft" not in plan.split("Scan parquet")[0]
    assert sorted((r["_task"], r["n"]) for r in tagged.groupBy("_task").agg(F.count_distinct("id").alias("n")).collect()) == [
        ("t0", 1000), ("t1", 1000)]
