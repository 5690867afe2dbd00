"""Query bindings: split, control sums, part numbering (D3, B6, D9, A10, A16,
E1, B11, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.operators import split as sp
from lakeshore.plans.control_sql import control_sum_ctes
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir

# The split cap used by the bindings, in records per file.
SPLIT_RECORDS = 1000
SPLIT_KEYS = ["k1", "k2"]
# Entities configured for the folder tasks (a per-source config of the
# test fixtures; the real config comes from the field config document).
CONFIG_ENTITIES = ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9"]


@query("control_sum", with_views(["li_trade"], "SELECT * FROM sums", **control_sum_ctes("li_trade")))
def q_control_sum(spark, sf_dir):
    return sp.control_sum(view(spark, sf_dir, "li_trade"))


@query("bad_code_counts", with_views(["li_trade"], """
SELECT dataset_checksum,
  count(*) FILTER ((mos_code IS NOT NULL AND try_cast(mos_code AS BIGINT) IS NULL)
                   OR (mot_code IS NOT NULL AND try_cast(mot_code AS BIGINT) IS NULL)) AS bad_codes
FROM li_trade GROUP BY dataset_checksum
"""))
def q_bad_code_counts(spark, sf_dir):
    return sp.bad_code_counts(view(spark, sf_dir, "li_trade"))


@query("drop_blank_keys", with_views(["li_keys"], """
SELECT * FROM li_keys
WHERE k1 IS NOT NULL AND trim(CAST(k1 AS STRING)) <> '' AND k2 IS NOT NULL AND trim(CAST(k2 AS STRING)) <> ''
"""))
def q_drop_blank_keys(spark, sf_dir):
    return sp.drop_blank_keys(view(spark, sf_dir, "li_keys"), SPLIT_KEYS)


def _split(spark, sf_dir):
    target = scratch_dir(spark, "split")
    res = sp.split_by_columns(view(spark, sf_dir, "li_keys"), target, SPLIT_KEYS, max_records=SPLIT_RECORDS)
    return res


_KEPT = """
SELECT * FROM li_keys WHERE k1 IS NOT NULL AND trim(k1) <> '' AND k2 IS NOT NULL AND trim(k2) <> ''
"""


@query("split_stats", with_views(["li_keys"], """
SELECT k1, k2, count(*) AS rows, TRUE AS within_cap, TRUE AS enough_parts FROM kept GROUP BY k1, k2
""", kept=_KEPT))
def q_split_stats(spark, sf_dir):
    return sp.split_summary(_split(spark, sf_dir), SPLIT_RECORDS)


@query("write_split", with_views(["li_keys"], "SELECT * FROM kept", kept=_KEPT))
def q_write_split(spark, sf_dir):
    res = _split(spark, sf_dir)
    return sp.read_split(spark, res.target).select("l_orderkey", "l_linenumber", "k1", "k2", "l_quantity")


@query("build_manifest", with_views(["li_keys"], """
SELECT k1, k2, count(*) AS rows, TRUE AS numbered FROM kept GROUP BY k1, k2
""", kept=_KEPT))
def q_build_manifest(spark, sf_dir):
    res = _split(spark, sf_dir)
    return (res.manifest.groupBy(*SPLIT_KEYS)
            .agg(F.sum("rows").alias("rows"),
                 (F.max("part_no") == F.count(F.lit(1))).alias("numbered")))


@query("number_parts", with_views(["paths"], """
SELECT id, path,
  printf('%03d', row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path)) AS part
FROM paths
"""))
def q_number_parts(spark, sf_dir):
    files = view(spark, sf_dir, "paths").select("id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("_folder"))
    return sp.number_parts(files, ["_folder"], "path").drop("_folder", "part_no")


_ENTITY_SQL = "(VALUES " + ", ".join(f"('{e}')" for e in CONFIG_ENTITIES) + ") AS cfg(entity)"


@query("allowed_entities", with_views(["paths"], f"""
SELECT id, entity, entity IN (SELECT entity FROM {_ENTITY_SQL}) AS allowed FROM t
""", t="""
SELECT id, list_filter(string_split(substr(path, length('/data/source/') + 1), '/'), lambda x: x <> '')[1] AS entity
FROM paths
"""))
def q_allowed_entities(spark, sf_dir):
    paths = view(spark, sf_dir, "paths")
    tasks = paths.select("id", sp.first_path_part(F.expr("substr(path, length('/data/source/') + 1)")).alias("entity"))
    cfg = spark.createDataFrame([(e,) for e in CONFIG_ENTITIES], "entity string")
    ok, bad = sp.allowed_entities(tasks, cfg)
    return ok.withColumn("allowed", F.lit(True)).unionByName(bad.withColumn("allowed", F.lit(False)))
