"""Plan shape: no cartesian products or nested-loop joins anywhere, the
split scans once, small dimension joins broadcast, filters reach the scan."""

import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.queries())
# Queries that write files or run streams while they are built; their plans
# are covered by the operator-level tests.
WRITES = {"split_stats", "write_split", "build_manifest", "append_log", "scan_csv", "scan_json", "scan_csv_as_text",
          "export_csv", "sequence_topk", "similarity_report", "read_tasks_stream", "write_messages",
          "normalize_task_stream", "split_poison_stream", "exactly_once_effect", "link_stream", "running_app_stats",
          "snapshots_stream", "alert_stream", "heavy_only_stream", "retry_then_dlq", "process_folder",
          "verification_stage", "process_folder_stage", "scan_registry", "register_files", "refresh_scan",
          "scan_combinations", "scan_row_counts", "register_counts", "refresh_counts"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in NAMES if n not in WRITES])
def test_no_cartesian(spark, sf, name):
    p = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_filters_pushed_to_scan(spark, sf):
    from pyspark.sql import functions as F
    df = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type") == "error").select("event_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in p


def test_sources_join_broadcasts(spark, sf):
    assert "BroadcastHashJoin" in plan(entry.queries()["sources_with_service"](spark, sf))


def test_no_costly_inferred_filters_at_scan(spark, sf):
    """Nullable join columns once made Catalyst push isnotnull(<whole
    expression>) to the scan, evaluating trigram sets / canonical URLs twice
    (the first time in a one-task scan stage)."""
    tri = plan(entry.queries()["trigram_topk"](spark, sf))
    assert "Filter isnotnull(size(" not in tri
    links = plan(entry.queries()["new_links"](spark, sf))
    assert "isnotnull(sha2(cast(concat(" not in links
