"""Query bindings: registry scan jobs (J1-J3) over a lake tree written from
``li_keys`` (two sources, two dates, plus a CSV and a JSON file)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.operators import scan
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir
from lakeshore.sources import sinks
from lakeshore.sources.files import file_catalog

CONFIG = {"src0": {"processing": {"split_columns": ["k1", "k2"]}}, "src1": ["k2", "l_linenumber"]}


def _lake(spark, sf_dir):
    root = scratch_dir(spark, "lake")
    li = view(spark, sf_dir, "li_keys")
    for s in (0, 1):
        for d in (1, 2):
            li.where((F.col("l_orderkey") % 2 == s) & (F.col("l_linenumber") % 2 == d - 1)) \
                .write.parquet(f"{root}/src{s}/2024-01-0{d}/202401")
    li.where(F.col("l_orderkey") % 5 == 0).select("l_orderkey", "k2").write.option("header", True) \
        .csv(f"{root}/src2/2024-01-03/misc")
    li.where(F.col("l_orderkey") % 7 == 0).select("l_orderkey", "k2").write.json(f"{root}/src2/2024-13-40/202401")
    return root


@query("scan_registry")
def q_scan_registry(spark, sf_dir):
    root = _lake(spark, sf_dir)
    return scan.scan_registry(spark, root, config=CONFIG)


@query("register_files")
def q_register_files(spark, sf_dir):
    root = _lake(spark, sf_dir)
    folders = sorted(r["parent"] for r in file_catalog(spark, root, "parquet").select("parent").distinct().collect())
    return scan.register_files(spark, folders, entity="src0", period="209912", config=CONFIG)


@query("refresh_scan")
def q_refresh_scan(spark, sf_dir):
    root = _lake(spark, sf_dir)
    # The registry also knows files under another root: for a refresh of
    # ``root`` those files are gone and their rows must become inactive.
    elsewhere = scratch_dir(spark, "lake-old")
    view(spark, sf_dir, "li_keys").where(F.col("l_orderkey") % 3 == 0).write.parquet(f"{elsewhere}/src0/2023-12-31/202312")
    table = scratch_dir(spark, "registry")
    sinks.write_version(scan.scan_registry(spark, root, config=CONFIG)
                        .unionByName(scan.scan_registry(spark, elsewhere, config=CONFIG)), table)
    existing = sinks.read_current(spark, table)
    return scan.refresh(spark, root, existing, config=CONFIG)


_VALIDATION = "row_count bigint, split_combinations array<array<string>>, distinct_values map<string,array<string>>"


def _facts(rows):
    """Registry rows with the facts of their validation document."""
    return rows.select("name", F.coalesce(F.date_format("upload_date", "yyyy-MM-dd"), F.lit("")).alias("day"), "period", "is_active",
                       F.from_json("validation", _VALIDATION).alias("v"))


_LAKE = """
SELECT concat('src', CAST(l_orderkey % 2 AS STRING)) AS name, concat('2024-01-0', CAST(l_linenumber % 2 + 1 AS STRING)) AS day, k1, k2, l_linenumber
FROM li_keys
"""


@query("scan_combinations", with_views(["li_keys"], """
SELECT DISTINCT name, day, 'combination' AS kind, CAST(k1 AS STRING) AS a, CAST(k2 AS STRING) AS b FROM lake WHERE name = 'src0'
UNION ALL SELECT DISTINCT name, day, 'value', 'k2', CAST(k2 AS STRING) FROM lake WHERE name = 'src1'
UNION ALL SELECT DISTINCT name, day, 'value', 'l_linenumber', CAST(l_linenumber AS STRING) FROM lake WHERE name = 'src1'
""", lake=_LAKE))
def q_scan_combinations(spark, sf_dir):
    """Every key combination and value that a scan finds, by source and day."""
    facts = _facts(scan.scan_registry(spark, _lake(spark, sf_dir), config=CONFIG))
    combos = facts.select("name", "day", F.lit("combination").alias("kind"), F.explode("v.split_combinations").alias("c")).select(
        "name", "day", "kind", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))
    values = facts.select("name", "day", F.lit("value").alias("kind"), F.explode("v.distinct_values").alias("a", "b"))
    return combos.unionByName(values.withColumn("b", F.explode("b"))).distinct()


@query("scan_row_counts", with_views(["li_keys"], """
SELECT name, day, count(*) AS n FROM lake GROUP BY ALL
UNION ALL SELECT 'src2', '2024-01-03', count(*) FROM li_keys WHERE l_orderkey % 5 = 0
UNION ALL SELECT 'src2', '', count(*) FROM li_keys WHERE l_orderkey % 7 = 0
""", lake=_LAKE))
def q_scan_row_counts(spark, sf_dir):
    """Rows of the scanned files (parquet, CSV, JSON) by source and day."""
    facts = _facts(scan.scan_registry(spark, _lake(spark, sf_dir), config=CONFIG))
    return facts.groupBy("name", "day").agg(F.sum("v.row_count").alias("n"))


@query("register_counts", with_views(["li_keys"], """
SELECT 'src0' AS name, '209912' AS period, day, count(*) AS n FROM lake GROUP BY day
UNION ALL SELECT 'src0', '209912', 'combinations', count(*) FROM (SELECT DISTINCT k1, k2 FROM li_keys)
""", lake=_LAKE))
def q_register_counts(spark, sf_dir):
    """Rows by day under the given name and period, and all combinations."""
    facts = _facts(q_register_files(spark, sf_dir))
    combos = facts.select("name", "period", F.lit("combinations").alias("day"), F.explode("v.split_combinations").alias("c"))
    return facts.groupBy("name", "period", "day").agg(F.sum("v.row_count").alias("n")).unionByName(
        combos.groupBy("name", "period", "day").agg(F.count_distinct("c").alias("n")))


@query("refresh_counts", with_views(["li_keys"], """
SELECT name, TRUE AS is_active, count(*) AS n FROM lake GROUP BY name
UNION ALL SELECT 'src2', TRUE, count(*) FILTER (WHERE l_orderkey % 5 = 0) + count(*) FILTER (WHERE l_orderkey % 7 = 0) FROM li_keys
UNION ALL SELECT 'src0', FALSE, count(*) FROM li_keys WHERE l_orderkey % 3 = 0
""", lake=_LAKE))
def q_refresh_counts(spark, sf_dir):
    """Rows of active files and of files that are gone."""
    return _facts(q_refresh_scan(spark, sf_dir)).groupBy("name", "is_active").agg(F.sum("v.row_count").alias("n"))
