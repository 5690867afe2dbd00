"""Sinks: versioned tables, export counts, appends, merge-on-read."""

from pyspark.sql import functions as F

from lakeshore.session import scratch_dir
from lakeshore.sources import sinks
from lakeshore.streaming.jobs import read_latest


def test_versions_newest_finished_wins(spark):
    root = scratch_dir(spark, "t-versions")
    assert sinks.current_version(spark, root) is None
    assert sinks.read_current(spark, root, "a long").count() == 0
    sinks.write_version(spark.range(3).withColumnRenamed("id", "a"), root)
    sinks.write_version(spark.range(5).withColumnRenamed("id", "a"), root)
    assert sinks.read_current(spark, root).count() == 5
    # A newer folder without _SUCCESS (a writer that has not finished) is
    # never read.
    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    unfinished = f"{root}/v=9999999999999-unfinished"
    os.makedirs(unfinished)
    pq.write_table(pa.table({"a": list(range(9))}), f"{unfinished}/part-0.parquet")
    assert sinks.read_current(spark, root).count() == 5


def test_export_counts_while_writing(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    target = scratch_dir(spark, "t-export")
    assert sinks.export_csv(nation, target) == nation.count()
    assert spark.read.option("header", True).csv(target).count() == nation.count()


def test_append_log_stamps(spark):
    target = scratch_dir(spark, "t-append")
    out = sinks.append_log(spark.range(4).withColumnRenamed("id", "user_id"), target)
    assert {"created_at", "id"} <= set(out.columns)
    back = spark.read.parquet(target)
    assert back.count() == 4 and back.where(F.col("id").isNull()).count() == 0


def test_read_latest_keeps_last_batch(spark):
    root = scratch_dir(spark, "t-mor")
    spark.createDataFrame([("a", "1", 0), ("b", "1", 0)], "key string, value string, batch_id long") \
        .drop("batch_id").write.parquet(f"{root}/batch_id=0")
    spark.createDataFrame([("a", "2")], "key string, value string").write.parquet(f"{root}/batch_id=1")
    got = {r.key: r.value for r in read_latest(spark, root, ["key"]).collect()}
    assert got == {"a": "2", "b": "1"}
