"""Schema extraction and comparison.

Field lists are DataFrames ``(schema_id, name, type)``, so thousands of
schemas are compared in one join instead of one Python loop per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshore.functions.types import (CONTRACT_SPARK, CONTRACT_TYPES, normalize_type, spark_type_name,
                                       type_compatible)
from lakeshore.sources import records
from lakeshore.sources.files import detect_format_by_name


def schema_diff(src: DataFrame, tgt: DataFrame, src_dialect: str, tgt_dialect: str,
                keys: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """C11: full outer join of two field lists per schema ->
    missing_in_target, extra_in_target, type_mismatch (incompatible types)."""
    k = list(keys)
    s = src.select(*k, "name", F.col("type").alias("source_type"))
    t = tgt.select(*k, "name", F.col("type").alias("target_type"))
    # The join shuffles both sides on the key, so the type rules run in
    # parallel after it.
    j = s.join(t, k + ["name"], "full")
    ok = type_compatible(normalize_type(F.col("source_type"), src_dialect),
                         normalize_type(F.col("target_type"), tgt_dialect))
    issue = (F.when(F.col("target_type").isNull(), F.lit("missing_in_target"))
             .when(F.col("source_type").isNull(), F.lit("extra_in_target"))
             .when(~ok, F.lit("type_mismatch")))
    return j.select(*k, F.col("name").alias("field"), issue.alias("issue"), "source_type", "target_type") \
        .where(F.col("issue").isNotNull())


def compatibility(src: DataFrame, tgt: DataFrame, src_dialect: str, tgt_dialect: str,
                  keys: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """H14 + H15 over the fields present on both sides."""
    k = list(keys)
    j = src.select(*k, "name", F.col("type").alias("st")).join(
        tgt.select(*k, "name", F.col("type").alias("tt")), k + ["name"])
    sn = normalize_type(F.col("st"), src_dialect)
    tn = normalize_type(F.col("tt"), tgt_dialect)
    return j.select(*k, "name", sn.alias("source_norm"), tn.alias("target_norm"),
                    type_compatible(sn, tn).alias("compatible"))


def field_set_ops(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """G1: names only on the left, only on the right, and common, per schema.
    One grouping of both lists, where every name says on which sides it was
    seen (nulls are equal, as in set operations)."""
    cols = list(keys) + ["name"]
    both = a.select(*cols, F.lit(1).alias("_side")).unionByName(b.select(*cols, F.lit(2).alias("_side")))
    seen = both.groupBy(*cols).agg(F.bit_or("_side").alias("_seen"))
    return seen.select(*cols, F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("_seen")).alias("side"))


def _footer_fields(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lakeshore.sources.streams import open_file
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            with open_file(path) as f:
                try:
                    for i, field in enumerate(pq.read_schema(f)):
                        rows.append((path, i, field.name, str(field.type), bool(field.nullable)))
                except pa.ArrowInvalid:     # not a parquet file; any other error fails the task
                    rows.append((path, -1, None, None, None))
        yield pd.DataFrame(rows, columns=["path", "pos", "field", "raw_type", "nullable"])


def extract_schema(catalog: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """H16 over a file catalog: one row per (file, field).  Parquet fields come
    from the footers, read inside the tasks that own the files, in the parquet
    dialect; those of CSV and JSON files from all their values, joined per
    file and column (``sources.records``), and may always be null.  A file
    that cannot be read gives one row with a null field.  ``roots``: folders
    that hold the text files (default: the catalog's common folder)."""
    spark = catalog.sparkSession
    by_name = detect_format_by_name(F.col("path"))
    footers = catalog.where(by_name == "parquet").select("path").mapInPandas(
        _footer_fields, "path string, pos int, field string, raw_type string, nullable boolean")
    texts = catalog.where(by_name != "parquet").select("path").distinct()
    found = records.text_schemas(spark, texts, roots)
    texts = texts.join(found, "path", "left").select("path", F.coalesce("pos", F.lit(-1)).alias("pos"), "field", "raw_type",
                                                     F.when(F.col("field").isNotNull(), True).alias("nullable"))
    typed = [footers.withColumn("type", normalize_type(F.col("raw_type"), "parquet")),
             texts.withColumn("type", normalize_type(F.col("raw_type"), "duckdb"))]
    return typed[0].unionByName(typed[1])


def describe(df: DataFrame) -> DataFrame:
    """H16 for one relation: field, DuckDB-style type, canonical type, nullable."""
    spark = df.sparkSession
    rows = [(f.name, spark_type_name(f.dataType), f.nullable) for f in df.schema.fields]
    out = spark.createDataFrame(rows, "field string, type string, nullable boolean")
    return out.withColumn("canonical", normalize_type(F.col("type"), "duckdb"))



def load_schema(docs: DataFrame, doc_col: str = "doc", key: str = "schema_id") -> DataFrame:
    """JSON schema documents in four layouts -> (key, name, type):
    a plain {name: type} map, {"schema": {...}}, {"columns": [...]},
    {"fields": [...]}; the first layout that applies wins."""
    v = F.try_parse_json(F.col(doc_col))
    shape = F.schema_of_variant(v)
    plain = shape.startswith("OBJECT<") & ~shape.rlike(r":\s(?!STRING[,>])")
    as_map = F.try_variant_get(v, "$", "map<string,string>")
    sch = F.try_variant_get(v, "$.schema", "map<string,string>")
    entry = "array<struct<name:string,type:string>>"
    cols_ = F.try_variant_get(v, "$.columns", entry)
    flds = F.try_variant_get(v, "$.fields", entry)
    pairs = (F.when(plain, F.map_entries(as_map))
             .when(sch.isNotNull(), F.map_entries(sch))
             .when(cols_.isNotNull(), F.transform(cols_, lambda x: F.struct(x["name"].alias("key"), x["type"].alias("value"))))
             .when(flds.isNotNull(), F.transform(flds, lambda x: F.struct(x["name"].alias("key"), x["type"].alias("value")))))
    return (docs.select(key, F.explode(pairs).alias("e"))
            .select(key, F.col("e.key").alias("name"), F.col("e.value").alias("type")))


def _iso(c: Column, dt) -> Column:
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    out = F.concat(base, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    if isinstance(dt, T.TimestampType):
        out = F.concat(out, F.lit("+00:00"))
    return out


def _safe(c: Column, dt) -> Column:
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(c.isNotNull(), _iso(c, dt))
    if isinstance(dt, T.DecimalType):
        return c.cast("double")
    if isinstance(dt, T.BinaryType):
        return F.coalesce(F.try_validate_utf8(c.cast("string")), F.lower(F.hex(c)))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as doubles, bytes as UTF-8
    text or else hex; recursive through arrays and structs.  Driven by the
    schema, evaluated as plain expressions."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def parse_json_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text that looks like {...} or [...] and parses becomes VARIANT;
    anything else stays text (kept next to it)."""
    out = df
    for c in cols:
        t = F.trim(F.col(c))
        looks = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
        # The parser stops after the first complete value; wrapping the text
        # in an array and asking for exactly one element rejects trailing text.
        strict = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
        out = out.withColumn(f"{c}_json", F.when(looks & strict, F.try_parse_json(t)))
    return out


def validate_contract(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """The contract's columns and types against the real schema, plus
    per column the number of non-null values that do not cast to the
    contract type (one aggregate pass over the data)."""
    spark = df.sparkSession
    actual = {f.name: spark_type_name(f.dataType) for f in df.schema.fields}
    present = [c for c in contract if c in actual]
    counts = {}
    if present:
        aggs = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(CONTRACT_SPARK.get(t, "string")).isNull())
                .alias(c) for c, t in contract.items() if c in actual]
        counts = df.agg(*aggs).first().asDict()
    rows = [(c, t, actual.get(c), c in actual, counts.get(c)) for c, t in contract.items()]
    out = spark.createDataFrame(rows, "name string, expected string, actual string, present boolean, failures long")
    exp = F.create_map(*[x for k, v in CONTRACT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    act = normalize_type(F.col("actual"), "duckdb")
    return out.withColumn("compatible", F.col("present") & type_compatible(act, exp[F.col("expected")]))


def schema_docs(fields: DataFrame, key: str = "schema_id") -> DataFrame:
    """Encode field lists as JSON documents in the four layouts by key % 4
    (used to test H17 on data that grows with the tables)."""
    grouped = fields.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "type"))).alias("f"))
    as_map = F.map_from_entries(F.col("f"))
    layout = F.col(key) % 4
    doc = (F.when(layout == 0, F.to_json(as_map))
           .when(layout == 1, F.to_json(F.struct(as_map.alias("schema"))))
           .when(layout == 2, F.to_json(F.struct(F.col("f").alias("columns"))))
           .otherwise(F.to_json(F.struct(F.col("f").alias("fields")))))
    return grouped.select(key, doc.alias("doc"))
