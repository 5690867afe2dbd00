"""Query bindings: service registry joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.operators import services as sv
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("sources_with_service", """
SELECT s_suppkey AS id, s_nationkey AS service_id, s_name AS name, n_name AS service_name
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def q_sources_with_service(spark, sf_dir):
    src = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("service_id"),
                                               F.col("s_name").alias("name"))
    svc = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return sv.sources_with_service(src, svc)


@query("version_sources", """
SELECT c_nationkey AS service_id, c_custkey AS version_id, o_orderkey AS source_id,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS source_name
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_acctbal > 0
""")
def q_version_sources(spark, sf_dir):
    versions = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("service_id"),
                                                    (F.col("c_acctbal") > 0).alias("is_active"))
    bridge = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("source_id"))
    sources = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                                     F.col("l_linenumber").cast("string")).alias("name"))
    return sv.service_version_sources(versions, bridge, sources)


@query("group_files", """
SELECT l_orderkey AS group_id, concat('http://h/', CAST(l_partkey % 3 AS STRING), '.parquet') AS url, l_linenumber AS seq,
  o_orderstatus AS group_status,
  l_linenumber <> min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey % 3) AS is_duplicate
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def q_group_files(spark, sf_dir):
    groups = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    files = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.concat(F.lit("http://h/"), (F.col("l_partkey") % 3).cast("string"), F.lit(".parquet")).alias("url"),
        F.col("l_linenumber").alias("seq"))
    return sv.group_files(groups, files).select("group_id", "url", "seq", "group_status", "is_duplicate")


@query("check_service", with_views(["paths"], """
SELECT 'nation_3' AS service, CASE WHEN missing = 0 AND empty = 0 THEN 'ok' ELSE 'incomplete' END AS status,
  total_checked, found, missing, empty
FROM (SELECT count(*) AS total_checked, count(*) FILTER (WHERE st = 'found') AS found,
             count(*) FILTER (WHERE st = 'missing') AS missing, CAST(0 AS BIGINT) AS empty
      FROM (SELECT f.folder, CASE WHEN EXISTS (SELECT 1 FROM paths p WHERE starts_with(p.path, concat('/data/source/', f.folder, '/')))
                                  THEN 'found' ELSE 'missing' END AS st
            FROM (SELECT DISTINCT trim(concat('src', CAST(s_suppkey % 25 AS STRING))) AS folder
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey
                  WHERE lower(trim(n_name)) = 'nation_3' AND n_nationkey % 5 <> 4 AND s_suppkey % 7 <> 0) f))
"""))
def q_check_service(spark, sf_dir):
    services = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                                                  (F.col("n_nationkey") % 5 != 4).alias("is_active"))
    sources = _t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("service_id"),
        F.concat(F.lit("src"), (F.col("s_suppkey") % 25).cast("string")).alias("name"),
        (F.col("s_suppkey") % 7 != 0).alias("is_active"))
    return sv.check_service(services, sources, view(spark, sf_dir, "paths"), "/data/source", " Nation_3 ")
