"""Query bindings: scans, round trips through other formats, catalog facts
(A1-A7, A14, H1, H16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir
from lakeshore.sources import files as src
from lakeshore.sources import sinks


@query("scan_parquet", "SELECT * FROM lineitem")
def q_scan_parquet(spark, sf_dir):
    return src.scan_parquet(spark, [f"{sf_dir}/lineitem.parquet"])


@query("scan_csv", "SELECT * FROM nation")
def q_scan_csv(spark, sf_dir):
    target = scratch_dir(spark, "csv")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.write.option("header", True).option("sep", ";").csv(target)
    df = src.scan_csv(spark, target)
    return df.select(*[F.col(c).cast(t) for c, t in nation.dtypes])


@query("scan_json", "SELECT * FROM region")
def q_scan_json(spark, sf_dir):
    target = scratch_dir(spark, "json")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    region.write.json(target)
    df = src.scan_json(spark, target)
    return df.select(*[F.col(c).cast(t) for c, t in region.dtypes])


@query("scan_csv_as_text", """
SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM nation
""")
def q_scan_csv_as_text(spark, sf_dir):
    target = scratch_dir(spark, "csv-text")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    # Header names padded with blanks: the reader strips them again.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    nation.select(*[F.col(c).alias(f" {c} ") for c in nation.columns]) \
        .write.option("header", True).option("sep", "|").option("encoding", "windows-1252").csv(target)
    return src.scan_csv_as_text(spark, target)


@query("read_table", "SELECT * FROM supplier")
def q_read_table(spark, sf_dir):
    return src.read_table(spark, "supplier", table_root=sf_dir)


@query("detect_format", with_views(["paths"], """
SELECT id, CASE ext WHEN '.parquet' THEN 'parquet' WHEN '.csv' THEN 'csv' WHEN '.txt' THEN 'csv' WHEN '.tsv' THEN 'csv'
                    WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'json' WHEN '.ndjson' THEN 'json' ELSE 'csv' END AS format
FROM (SELECT id, regexp_extract(regexp_extract(regexp_replace(lower(path), '(\\.sended|\\.processed|\\.tmp|\\.bak)$', ''),
                                               '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1) AS ext FROM paths)
"""))
def q_detect_format(spark, sf_dir):
    return view(spark, sf_dir, "paths").select("id", src.detect_format_by_name(F.col("path")).alias("format"))


@query("detect_format_files")
def q_detect_format_files(spark, sf_dir):
    return src.detect_format(src.file_catalog(spark, sf_dir)).select("name", "format")


@query("file_catalog")
def q_file_catalog(spark, sf_dir):
    return src.file_catalog(spark, sf_dir, "parquet, .PARQUET").select("name", "parent", "ext", "length")


@query("file_sha256")
def q_file_sha256(spark, sf_dir):
    return src.file_sha256(spark, src.file_catalog(spark, sf_dir)).select("name", "length", "sha256")


@query("export_csv", """
SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey,
  (SELECT count(*) FROM nation) AS exported
FROM nation
""")
def q_export_csv(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    target = scratch_dir(spark, "export")
    n = sinks.export_csv(nation, target)
    return spark.read.option("header", True).csv(target).withColumn("exported", F.lit(n).cast("long"))
