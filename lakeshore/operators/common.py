"""Helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Before CPU-heavy row work (tokenising, regexes over long texts):
    when the input has fewer partitions than the cluster has cores (one
    large row group, a small table), round-robin it over all cores.  On a
    large input with many splits this is a no-op, so no shuffle is added
    where the scan is already parallel."""
    if df.isStreaming:
        return df   # a micro-batch is planned per trigger; nothing to inspect here
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def exact_sum(c: Column) -> Column:
    """Sum of doubles through DECIMAL: independent of the partition order."""
    return F.sum(c.cast("decimal(38,9)")).cast("double")
