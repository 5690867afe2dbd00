"""Query bindings: dataset registry (H2-H5, H25, D1, D2, D5, D6, A11, A13,
C4, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.functions import core as fn
from lakeshore.operators import registry as reg
from lakeshore.plans.registry import query
from lakeshore.plans.views import RAW_TABLES, view, with_views
from lakeshore.session import scratch_dir
from lakeshore.sources import files as src
from lakeshore.sources import sinks


@query("dataset_key", with_views(["docs_registry"], """
SELECT hash_sum, sha256(concat_ws(':', coalesce(name, 'None'), coalesce(period, 'None'), coalesce(link, 'None'))) AS dataset_key
FROM docs_registry
"""))
def q_dataset_key(spark, sf_dir):
    r = view(spark, sf_dir, "docs_registry")
    return r.select("hash_sum", fn.dataset_key("name", "period", "link").alias("dataset_key"))


@query("path_metadata", with_views(["paths"], """
SELECT id, CASE WHEN idx > 1 THEN parts[idx - 1] END AS source,
  CASE WHEN idx > 0 AND idx < len(parts) AND regexp_full_match(parts[idx + 1], '\\d{4}|\\d{6}|\\d{8}') THEN parts[idx + 1] END AS period,
  CASE WHEN idx > 0 THEN CAST(try_strptime(parts[idx], '%Y-%m-%d') AS DATE) END AS date
FROM (SELECT id, parts, coalesce(list_position(list_transform(parts, lambda x: regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}')), true), 0) AS idx
      FROM (SELECT id, CASE WHEN path LIKE '/%' THEN list_concat(['/'], list_filter(string_split(path, '/'), lambda x: x <> ''))
                            ELSE list_filter(string_split(path, '/'), lambda x: x <> '') END AS parts FROM paths))
"""))
def q_path_metadata(spark, sf_dir):
    p = view(spark, sf_dir, "paths")
    return p.select("id", fn.path_metadata("path").alias("m")).select("id", "m.source", "m.period", "m.date")


@query("parse_date", with_views(["date_texts"], """
SELECT id, text, coalesce(
    CASE WHEN regexp_full_match(trim(text), '\\d{4}-\\d{2}-\\d{2}') THEN CAST(try_strptime(trim(text), '%Y-%m-%d') AS DATE) END,
    CAST(try_strptime(trim(text), ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M',
                                   '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y%m%d']) AS DATE)) AS parsed
FROM date_texts
"""))
def q_parse_date(spark, sf_dir):
    return view(spark, sf_dir, "date_texts").select("id", "text", fn.parse_date("text").alias("parsed"))


@query("clean_period", with_views(["docs_registry"], """
SELECT hash_sum, nullif(trim(CASE CAST(hash_sum AS BIGINT) % 3 WHEN 0 THEN concat(' ', period, ' ')
                                  WHEN 1 THEN '   ' ELSE period END), '') AS period
FROM docs_registry
"""))
def q_clean_period(spark, sf_dir):
    r = view(spark, sf_dir, "docs_registry")
    raw = F.expr("CASE CAST(hash_sum AS BIGINT) % 3 WHEN 0 THEN concat(' ', period, ' ') WHEN 1 THEN '   ' ELSE period END")
    return r.select("hash_sum", fn.clean_period(raw).alias("period"))


@query("aggregate_by_name", with_views(["docs_registry"], """
SELECT name, period, SUM(size) AS size, SUM(rows) AS rows FROM (
  SELECT name, period,
    COALESCE(TRY_CAST(json_extract_string(validation, '$.file_size') AS BIGINT), 0) AS size,
    COALESCE(TRY_CAST(json_extract_string(validation, '$.row_count') AS BIGINT), 0) AS rows
  FROM docs_registry WHERE validation IS NOT NULL AND is_active)
GROUP BY name, period ORDER BY name NULLS LAST, period NULLS LAST LIMIT 30 OFFSET 5
"""))
def q_aggregate_by_name(spark, sf_dir):
    return reg.aggregate_by_name(view(spark, sf_dir, "docs_registry"), None, skip=5, limit=30)


@query("aggregate_by_name_one", with_views(["docs_registry"], """
SELECT name, period, SUM(size) AS size, SUM(rows) AS rows FROM (
  SELECT name, period,
    COALESCE(TRY_CAST(json_extract_string(validation, '$.file_size') AS BIGINT), 0) AS size,
    COALESCE(TRY_CAST(json_extract_string(validation, '$.row_count') AS BIGINT), 0) AS rows
  FROM docs_registry WHERE validation IS NOT NULL AND is_active AND name = 'src3')
GROUP BY name, period
"""))
def q_aggregate_by_name_one(spark, sf_dir):
    return reg.aggregate_by_name(view(spark, sf_dir, "docs_registry"), "src3", limit=None)


_REG_COLS = "hash_sum, name, period, link, validation, is_active"


@query("upsert_registry", with_views(["registry_updates"], f"""
SELECT {_REG_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY hash_sum ORDER BY prio DESC, seq DESC) AS rn FROM (
    SELECT {_REG_COLS}, 0 AS prio, 0 AS seq FROM docs_registry
    UNION ALL SELECT {_REG_COLS}, 1 AS prio, seq FROM registry_updates))
WHERE rn = 1
"""))
def q_upsert_registry(spark, sf_dir):
    upd = view(spark, sf_dir, "registry_updates")
    existing = spark.table("docs_registry")
    return reg.upsert(existing, upd, ["hash_sum"], order_col="seq")


@query("missing_files", with_views(["catalog_now", "docs_registry"], f"""
SELECT hash_sum, name, period, link, validation, FALSE AS is_active FROM docs_registry r
WHERE is_active AND NOT EXISTS (SELECT 1 FROM catalog_now c WHERE c.path = r.link)
"""))
def q_missing_files(spark, sf_dir):
    catalog = view(spark, sf_dir, "catalog_now")
    registry = view(spark, sf_dir, "docs_registry")
    return reg.missing_files(registry, catalog)


@query("refresh_registry", with_views(["catalog_now", "docs_registry"], f"""
SELECT hash_sum, name, period, link, validation,
  is_active AND EXISTS (SELECT 1 FROM catalog_now c WHERE c.path = r.link) AS is_active
FROM docs_registry r
"""))
def q_refresh_registry(spark, sf_dir):
    catalog = view(spark, sf_dir, "catalog_now")
    registry = view(spark, sf_dir, "docs_registry")
    return reg.apply_deactivation(registry, reg.missing_files(registry, catalog))


@query("update_registry", with_views(["registry_changes"], """
SELECT r.hash_sum, coalesce(c.name, r.name) AS name, coalesce(c.period, r.period) AS period,
  r.link, r.validation, r.is_active
FROM docs_registry r LEFT JOIN registry_changes c ON c.hash_sum = r.hash_sum
"""))
def q_update_registry(spark, sf_dir):
    changes = view(spark, sf_dir, "registry_changes")
    return reg.update_registry(spark.table("docs_registry"), changes)


@query("missing_counts", with_views(["catalog_now", "docs_registry"], """
SELECT count(*) FILTER (is_active) AS checked,
  count(*) FILTER (is_active AND link NOT IN (SELECT path FROM catalog_now)) AS missing,
  count(*) FILTER (is_active AND link NOT IN (SELECT path FROM catalog_now)) AS updated
FROM docs_registry
"""))
def q_missing_counts(spark, sf_dir):
    return reg.missing_counts(view(spark, sf_dir, "docs_registry"), view(spark, sf_dir, "catalog_now"))


_NEW_ROWS = """
SELECT CASE WHEN CAST(hash_sum AS BIGINT) % 2 = 0 THEN hash_sum END AS hash_sum, concat('made ', name) AS name, period, link
FROM docs_registry WHERE CAST(hash_sum AS BIGINT) % 9 = 0
"""


@query("create_registry", with_views(["docs_registry"], """
SELECT r.hash_sum, coalesce(c.name, r.name) AS name, coalesce(c.period, r.period) AS period,
  coalesce(c.link, r.link) AS link, r.validation, r.is_active
FROM docs_registry r LEFT JOIN made c ON c.hash_sum = r.hash_sum
UNION ALL
SELECT sha256(concat_ws(':', coalesce(name, 'None'), coalesce(period, 'None'), coalesce(link, 'None'))), name, period, link,
  NULL, TRUE
FROM made WHERE hash_sum IS NULL
""", made=_NEW_ROWS))
def q_create_registry(spark, sf_dir):
    r = view(spark, sf_dir, "docs_registry")
    number = F.col("hash_sum").cast("bigint")
    made = r.where(number % 9 == 0).select(F.when(number % 2 == 0, F.col("hash_sum")).alias("hash_sum"),
                                           F.concat(F.lit("made "), "name").alias("name"), "period", "link")
    return reg.create_or_update(r, made)


@query("distinct_values", with_views(["li_keys"], """
SELECT 'k1' AS field, CAST(k1 AS STRING) AS value FROM li_keys
UNION SELECT 'k2' AS field, CAST(k2 AS STRING) AS value FROM li_keys
UNION SELECT 'l_linenumber' AS field, CAST(l_linenumber AS STRING) AS value FROM li_keys
"""))
def q_distinct_values(spark, sf_dir):
    return reg.distinct_values(view(spark, sf_dir, "li_keys"), ["k1", "k2", "l_linenumber", "not_a_column"])


@query("distinct_combinations", """
SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem
""")
def q_distinct_combinations(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return reg.distinct_combinations(li, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}.parquet' AS name, count(*) AS rows FROM {t}" for t in RAW_TABLES))
def q_row_counts(spark, sf_dir):
    catalog = src.file_catalog(spark, sf_dir, "parquet")
    return src.row_counts(spark, catalog).select("name", "rows")


@query("append_log", with_views(["events_login"], "SELECT * FROM events_login"))
def q_append_log(spark, sf_dir):
    logins = view(spark, sf_dir, "events_login")
    target = scratch_dir(spark, "append-log")
    sinks.append_log(logins.where(F.col("id") % 2 == 0), target)
    sinks.append_log(logins.where(F.col("id") % 2 == 1), target)
    return spark.read.parquet(target).select(*logins.columns)
