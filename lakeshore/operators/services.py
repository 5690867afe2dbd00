"""Service / source registry joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.operators.catalog import folder_check
from lakeshore.operators.links import SALT


def sources_with_service(sources: DataFrame, services: DataFrame, name: str | None = None) -> DataFrame:
    """Each source with its service (inner equi join), optionally one
    service by name, ordered by service then source."""
    svc = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    if name is not None:
        svc = svc.where(F.col("service_name") == name)
    j = sources.join(svc, "service_id")
    return j.orderBy("service_name", "name", "id")


def service_version_sources(versions: DataFrame, bridge: DataFrame, sources: DataFrame,
                            active_only: bool = True) -> DataFrame:
    """Service -> versions (one to many) -> sources (many to many through
    the bridge)."""
    v = versions.where(F.col("is_active")) if active_only else versions
    return (v.select("service_id", F.col("id").alias("version_id"))
            .join(bridge.select("version_id", "source_id"), "version_id")
            .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id"))


def group_files(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each download group; the first row of a (group, url)
    pair is kept, later ones are flagged duplicates.  The files are reduced
    to one row per pair first; that table meets the groups, and its verdicts
    go back to the files by the pair salted with the row, so neither a hot
    group nor a hot pair is one task's work."""
    known = groups.select(F.col("id").alias("group_id"), F.col("status").alias("group_status"))
    first = files.groupBy("group_id", "url").agg(F.min("seq").alias("_first")).join(known, "group_id")
    first = first.withColumnsRenamed({"group_id": "_g", "url": "_u"}).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    rows = files.withColumn("_salt", F.pmod(F.xxhash64(*files.columns), F.lit(SALT)))
    out = rows.join(first, (F.col("group_id") == F.col("_g")) & F.col("url").eqNullSafe(F.col("_u"))
                    & (F.col("_salt") == F.col("_copy")))
    flagged = out.withColumn("is_duplicate", F.col("seq") != F.col("_first"))
    return flagged.select("group_id", "group_status", *[c for c in files.columns if c != "group_id"], "is_duplicate")


def check_service(services: DataFrame, sources: DataFrame, catalog: DataFrame, root: str, name: str,
                  dirs: DataFrame | None = None) -> DataFrame:
    """Active service by trimmed lower-case name -> its active sources by
    name -> C8 over the catalog (and ``dirs``, the folders that are there).  Unknown service: one error row; a service
    without sources: a zero-count row with status ``no sources``."""
    spark = services.sparkSession
    svc = services.where(F.col("is_active") & (F.lower(F.trim("name")) == name.strip().lower()))
    srcs = sources.where(F.col("is_active")).join(svc.select(F.col("id").alias("service_id")), "service_id")
    checked = folder_check(srcs.select(F.col("name").alias("folder"), F.col("id").alias("ord")), catalog, root, dirs=dirs)
    summary = checked.agg(F.count(F.lit(1)).alias("total_checked"),
                          F.count_if(F.col("status") == "found").alias("found"),
                          F.count_if(F.col("status") == "missing").alias("missing"),
                          F.count_if(F.col("status") == "empty").alias("empty"))
    known = svc.limit(1).count() > 0
    if not known:
        return spark.createDataFrame([(name.strip().lower(), "error", 0, 0, 0, 0)],
                                     "service string, status string, total_checked long, found long, missing long, empty long")
    return summary.select(F.lit(name.strip().lower()).alias("service"),
                          F.when(F.col("total_checked") == 0, F.lit("no sources"))
                          .when((F.col("missing") == 0) & (F.col("empty") == 0), F.lit("ok")).otherwise(F.lit("incomplete"))
                          .alias("status"), "total_checked", "found", "missing", "empty")
