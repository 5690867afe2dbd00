"""Sinks: CSV export, appends, message topics and versioned tables.

A registry table is a folder of versions ``v=<millis>-<id>``; a writer
finishes a complete version (Spark's commit protocol leaves ``_SUCCESS``)
and readers take the newest finished one.  Replacing a table is therefore
atomic for readers without a table format, and a lost executor only
re-runs its tasks inside the same uncommitted version.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_dirs(spark: SparkSession, root: str) -> list[str]:
    fs, p, _ = _fs(spark, root)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return bool(fs.exists(p))


def write_version(df: DataFrame, root: str, mode_partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version of the table at ``root``."""
    name = f"v={int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    target = f"{root.rstrip('/')}/{name}"
    w = df.write.mode("errorifexists").option("compression", "zstd")
    if mode_partition_by:
        w = w.partitionBy(*mode_partition_by)
    w.parquet(target)
    return target


def current_version(spark: SparkSession, root: str) -> str | None:
    versions = sorted(d for d in list_dirs(spark, root) if d.startswith("v="))
    for v in reversed(versions):
        if exists(spark, f"{root.rstrip('/')}/{v}/_SUCCESS"):
            return f"{root.rstrip('/')}/{v}"
    return None


def read_current(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    path = current_version(spark, root)
    if path is None:
        if schema is None:
            raise FileNotFoundError(f"no finished version under {root}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> int:
    """Write CSV with a header and return the rows exported, counted
    while writing (an ``Observation``, no second scan)."""
    obs = Observation("export")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(path)
    return int(obs.get["rows"])


def append_log(df: DataFrame, path: str, ts_col: str | None = "created_at", id_col: str | None = "id") -> DataFrame:
    """Append rows stamped with the server time and a generated id."""
    out = df
    if ts_col and ts_col not in df.columns:
        out = out.withColumn(ts_col, F.current_timestamp())
    if id_col and id_col not in df.columns:
        out = out.withColumn(id_col, F.expr("uuid()"))
    out.write.mode("append").parquet(path)
    return out


def to_messages(df: DataFrame, topic: str, key_col: str | None = None, partition_col: str | None = None) -> DataFrame:
    """A9 (shape): key, value = JSON of the row, topic, optional partition."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"), F.lit(topic).alias("topic")]
    if key_col:
        cols.insert(0, F.col(key_col).cast("string").alias("key"))
    if partition_col:
        cols.append(F.col(partition_col).cast("int").alias("partition"))
    return df.select(*cols)


def write_messages(df: DataFrame, topic: str, sink: str = "kafka", options: dict | None = None,
                   path: str | None = None, key_col: str | None = None, partition_col: str | None = None) -> None:
    """Publish rows as JSON messages.  ``kafka`` needs the connector and
    ``kafka.bootstrap.servers`` in ``options``; ``json`` writes the same
    messages to files (tests, and where no broker is available)."""
    msgs = to_messages(df, topic, key_col, partition_col)
    if sink == "kafka":
        w = msgs.write.format("kafka")
        for k, v in (options or {}).items():
            w = w.option(k, v)
        w.save()
    else:
        msgs.write.mode("append").json(path)
