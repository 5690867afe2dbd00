"""Registry scan jobs (J1-J3): list a lake folder, compute per-file facts
(path metadata, SHA-256, size, rows, distinct key combinations or values per
the source config), build the ``validation`` document, upsert by hash and
deactivate rows whose file has gone.  Each fact is a Spark job over the
files; they meet in joins on the path."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions.core import path_metadata
from lakeshore.operators import registry as reg
from lakeshore.session import scratch_dir
from lakeshore.sources import files as src
from lakeshore.sources import records

REGISTRY_SCHEMA = ("hash_sum string, name string, period string, upload_date date, link string, "
                   "validation string, is_active boolean")


def source_rule(cfg) -> tuple[str, list[str]]:
    """('combinations', split columns) or ('values', fields) or ('none', [])
    for one source's config entry: a dict with processing.split_columns or
    split_columns (combinations), else fields / distinct_fields (values);
    a plain list means distinct values of those fields."""
    if isinstance(cfg, dict):
        proc = cfg.get("processing")
        cols = proc.get("split_columns") if isinstance(proc, dict) else None
        cols = cols or cfg.get("split_columns")
        if cols:
            return "combinations", [cols] if isinstance(cols, str) else list(cols)
        fields = cfg.get("fields") or cfg.get("distinct_fields")
        if isinstance(fields, list) and fields:
            return "values", list(fields)
    elif isinstance(cfg, list) and cfg:
        return "values", list(cfg)
    return "none", []


def _footer_types(batches):
    """Names and Spark types of the columns of parquet files."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    from lakeshore.sources.streams import open_file
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            with open_file(path) as f:
                try:
                    for field in pq.read_schema(f):
                        rows.append((path, field.name, from_arrow_type(field.type).simpleString()))
                except pa.ArrowInvalid:     # not a parquet file; any other error fails the task
                    continue
        yield pd.DataFrame(rows, columns=["path", "field", "type"])


def _columns_by_file(files: DataFrame, cols: list[str]) -> DataFrame:
    """(path, present, signature): which of ``cols`` a parquet file has, and their types."""
    types = files.select("path").mapInPandas(_footer_types, "path string, field string, type string")
    wanted = types.where(F.col("field").isin(cols)).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("field", "type"))).alias("f"))
    return wanted.select("path", F.col("f.field").alias("present"), F.to_json("f").alias("signature"))


def _read_columns(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """The wanted columns as text, ``path`` and ``present``, of ``files``
    (as ``_columns_by_file`` gives them).  Where the files' common folder
    holds nothing else and no column has two types, the folder is read once
    under the joined schema; else each kind of schema is read by itself."""
    kinds = [r["signature"] for r in files.select("signature").distinct().collect()]
    if not kinds:
        return None
    fields: dict[str, set[str]] = {}
    for kind in kinds:
        for f in json.loads(kind):
            fields.setdefault(f["field"], set()).add(f["type"])

    def read(paths: list[str], types: dict[str, str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
        data = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET_FILES).parquet(*paths)
        text = [F.col(f"`{c}`").cast("string").alias(c) if c in types else F.lit(None).cast("string").alias(c) for c in sorted(fields)]
        return data.select(src.local_path(F.col("_metadata.file_path")).alias("path"), *text)

    folder = records.common_folder(files)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET_FILES).load(folder)
    if all(len(t) == 1 for t in fields.values()) and listed.select("path").count() == files.count():
        data = read([folder], {c: next(iter(t)) for c, t in fields.items()})
    else:
        parts = []
        for kind in kinds:
            paths = [r["path"] for r in files.where(F.col("signature") == kind).select("path").collect()]
            parts.append(read(paths, {f["field"]: f["type"] for f in json.loads(kind)}))
        data = reduce(DataFrame.unionByName, parts)
    return data.join(files.select("path", "present"), "path")


PARQUET_FILES = "*.{parquet,parquet.sended,parquet.processed,parquet.tmp,parquet.bak}"


def _per_file_facts(spark: SparkSession, files: DataFrame, rule: str, cols: list[str]) -> DataFrame | None:
    """Per parquet file of one source: combinations (sorted list) and their
    number, of files that have all ``cols``; or distinct values of each field
    that a file has.  Files may differ in columns and types."""
    if rule == "none":
        return None
    parquet = files.where(src.detect_format_by_name(F.col("path")) == "parquet")
    known = materialise(_columns_by_file(parquet, cols), "footers")
    if rule == "combinations":
        known = known.where(F.size("present") == len(set(cols)))
    data = _read_columns(spark, known)
    if data is None:
        return None
    if rule == "combinations":
        combos = data.select("path", F.array(*[F.col(f"`{c}`") for c in cols]).alias("c")).distinct()
        per = combos.groupBy("path").agg(F.sort_array(F.collect_list("c")).alias("split_combinations"))
        return per.withColumn("split_combinations_count", F.size("split_combinations"))
    some = [c for c in dict.fromkeys(cols) if c in data.columns]
    pairs = ", ".join(f"'{c}', `{c}`" for c in some)
    vals = data.selectExpr("path", "present", f"stack({len(some)}, {pairs}) AS (field, value)")
    vals = vals.where(F.array_contains("present", F.col("field"))).select("path", "field", "value").distinct()
    # Null is one of the distinct values: collect structs (kept even when
    # the value is null) and unwrap them.
    per = vals.groupBy("path", "field").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("value"))), lambda s: s["value"]).alias("v"))
    return per.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("distinct_values"))


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Written once below the shared folder and read back."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_files(spark: SparkSession, catalog: DataFrame, config: dict | None = None,
               explicit: dict | None = None) -> DataFrame:
    """Registry rows for the files of ``catalog``.  ``explicit`` (name,
    period, upload_date) beat the values found in the path (J2)."""
    config = config or {}
    explicit = explicit or {}
    meta = catalog.select("path", "length", path_metadata("path").alias("m"))
    name = F.coalesce(F.lit(explicit.get("name")).cast("string"), F.col("m.source"))
    period = F.coalesce(F.lit(explicit.get("period")).cast("string"), F.col("m.period"))
    date = F.coalesce(F.lit(explicit.get("upload_date")).cast("date"), F.col("m.date"))
    base = meta.select("path", "length", name.alias("name"), period.alias("period"), date.alias("upload_date"))
    hashes = src.file_sha256(spark, catalog).select("path", "sha256")
    counts = src.row_counts(spark, catalog).select("path", "rows")
    out = base.join(hashes, "path", "left").join(counts, "path", "left")
    facts = []
    for source, cfg in config.items():
        rule, cols = source_rule(cfg)
        f = _per_file_facts(spark, base.where(F.col("name") == source), rule, cols)
        if f is not None:
            facts.append(f)
    extra = {"split_combinations": "array<array<string>>", "split_combinations_count": "int",
             "distinct_values": "map<string,array<string>>"}
    if facts:
        allf = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
        out = out.join(allf, "path", "left")
    for c, t in extra.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    validation = F.to_json(F.struct(F.col("length").alias("file_size"), F.col("rows").alias("row_count"),
                                    "split_combinations", "split_combinations_count", "distinct_values"))
    return out.select(F.col("sha256").alias("hash_sum"), "name", "period", "upload_date", F.col("path").alias("link"),
                      validation.alias("validation"), F.lit(True).alias("is_active"))


def scan_registry(spark: SparkSession, root: str, existing: DataFrame | None = None, config: dict | None = None,
                  extensions="*") -> DataFrame:
    """Scan a folder and upsert its files into the registry (by hash)."""
    rows = scan_files(spark, src.file_catalog(spark, root, extensions), config)
    if existing is None:
        return rows
    return reg.upsert(existing, rows, ["hash_sum"])


def register_files(spark: SparkSession, paths: list[str], existing: DataFrame | None = None, entity: str | None = None,
                   period: str | None = None, updated_at: str | None = None, config: dict | None = None) -> DataFrame:
    """Register the given files; explicit values beat path metadata."""
    catalog = src.with_name_parts(spark.read.format("binaryFile").load(paths)
                                  .select(src.local_path(F.col("path")).alias("path"), "length",
                                          F.col("modificationTime").alias("mtime")))
    rows = scan_files(spark, catalog, config, {"name": entity, "period": period, "upload_date": updated_at})
    return rows if existing is None else reg.upsert(existing, rows, ["hash_sum"])


def refresh(spark: SparkSession, root: str, existing: DataFrame, config: dict | None = None) -> DataFrame:
    """J1, then C4 over the whole registry (rows whose file is gone
    become inactive; a file that is back becomes active again via J1)."""
    catalog = src.file_catalog(spark, root)
    scanned = reg.upsert(existing, scan_files(spark, catalog, config), ["hash_sum"])
    gone = reg.missing_files(scanned, catalog.select("path"))
    return reg.apply_deactivation(scanned, gone)
