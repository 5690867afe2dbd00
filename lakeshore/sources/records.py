"""Records and field types of text files, for any number of files at once.

Files are read below their common folder by name pattern and matched to the
catalog by path, so no list of paths passes through the driver.  A JSON file
is read line by line where every line is JSON by itself; any other is one
document and its task reads it whole.  A CSV file is read line by line with
its own delimiter; only a file with line breaks inside quotes is streamed by
one task.

Types: every value votes with one bit, ``bit_or`` joins the votes per file and
column (so partial results merge in any order), and the joined bits name the
narrowest type that holds all values.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.sources.files import STATE_SUFFIXES, detect_format_by_name, file_head, local_path
from lakeshore.sources.streams import open_stream

#: Bits of a vote.
INTEGER, DOUBLE, BOOLEAN, DATE, TIMESTAMP, TEXT, NESTED = (1 << i for i in range(7))
_INTEGER = r"^[+-]?\d{1,18}$"
_DOUBLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"


def name_pattern(files: DataFrame) -> str | None:
    """Glob that finds the names of ``files`` by their endings, which are few; None without files."""
    state = "|".join(x.replace(".", r"\.") for x in STATE_SUFFIXES)
    ending = F.regexp_extract("path", rf"(\.[^./]*?(?:{state})?|)$", 1)
    found = sorted(r["e"] for r in files.select(ending.alias("e")).distinct().collect())
    if not found:
        return None
    if any(not re.fullmatch(r"(\.[\w-]+)+", e) for e in found):
        return "*"
    return "{" + ",".join(f"*{e}" for e in found) + "}"


def common_folder(catalog: DataFrame) -> str | None:
    """The deepest folder that holds every file of the catalog."""
    r = catalog.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    if r["a"] is None:
        return None
    a, b = (x.rsplit("/", 1)[0].split("/") for x in (r["a"], r["b"]))
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return "/".join(a[:same]) or "/"


def of_format(catalog: DataFrame, fmt: str) -> DataFrame:
    """Paths of a format by name (other names count as CSV)."""
    return catalog.where(detect_format_by_name(F.col("path")) == fmt).select("path").distinct()


def text_lines(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """(path, value): the lines of ``files``, read below ``roots``."""
    pattern = name_pattern(files)
    if pattern is None:
        return spark.createDataFrame([], "path string, value string")
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(roots)
    lines = read.select(local_path(F.col("_metadata.file_path")).alias("path"), "value")
    return of_files(lines, files)


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose ``path`` is one of ``files``.  Compared as structs: with
    plain columns Spark would infer that a row's path, too, meets whatever
    ``files`` was filtered by (the name rules) and test that on every row."""
    listed = files.select(F.struct("path").alias("_listed"))
    return rows.join(listed, F.struct(rows["path"]) == F.col("_listed"), "left_semi")


# ---- JSON ---------------------------------------------------------------

def _documents(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path in pdf["path"]:
            with open_stream(path) as f:
                yield pd.DataFrame({"path": [path], "value": [f.read().decode("utf-8-sig", "replace")]})


def json_layout(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """(path, alone): whether every line of a file is JSON by itself."""
    lines = text_lines(spark, files, roots).where(F.trim("value") != "")
    return lines.groupBy("path").agg(F.bool_and(F.try_parse_json(_unmarked("value")).isNotNull()).alias("alone"))


def _unmarked(c: str) -> Column:
    """Without a byte order mark."""
    return F.regexp_replace(c, "^﻿", "")


def json_records(spark: SparkSession, files: DataFrame, roots: list[str], layout: DataFrame | None = None) -> DataFrame:
    """(path, record): each JSON value of each file as a variant; the items
    of an array are records of their own.  A file that is no JSON at all is
    one null record."""
    layout = json_layout(spark, files, roots) if layout is None else layout
    lines = text_lines(spark, layout.where("alone").select("path"), roots).where(F.trim("value") != "")
    whole = layout.where(~F.col("alone")).select("path").mapInPandas(_documents, "path string, value string")
    values = lines.unionByName(whole).select("path", F.try_parse_json(_unmarked("value")).alias("v"))
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return values.select("path", F.explode(items).alias("record"))


def _json_vote(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (F.when(v.isNull() | (kind == "VOID"), 0).when(kind == "BIGINT", INTEGER)
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), DOUBLE).when(kind == "BOOLEAN", BOOLEAN)
            .when(kind == "STRING", _text_vote(v.cast("string"))).otherwise(NESTED))


def _text_vote(t: Column) -> Column:
    return (F.when(t.rlike(_DATE) & F.try_to_date(t).isNotNull(), DATE)
            .when(t.rlike(_TIMESTAMP) & F.try_to_timestamp(t).isNotNull(), TIMESTAMP).otherwise(TEXT))


def json_votes(records: DataFrame) -> DataFrame:
    """(path, pos, field, votes) of the fields of objects; fields of a file in
    the order of their names, as Spark's own reader has them."""
    objects = records.where(F.schema_of_variant("record").startswith("OBJECT"))
    fields = objects.select("path", F.explode(F.try_variant_get("record", "$", "map<string,variant>")).alias("field", "value"))
    per = fields.groupBy("path", "field").agg(F.bit_or(_json_vote(F.col("value"))).alias("votes"))
    listed = per.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("field", "votes"))).alias("f"))
    return listed.select("path", F.posexplode("f").alias("pos", "f")).select("path", "pos", "f.field", "f.votes")


# ---- CSV ----------------------------------------------------------------

def _heads(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            lines, sep = file_head(path)
            header = next(csv.reader(lines, delimiter=sep), []) if lines else []
            rows.append((path, sep, lines[0].rstrip("\r\n") if lines else None, [x.strip() for x in header]))
        yield pd.DataFrame(rows, columns=["path", "sep", "head", "header"])


def _streamed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of files with line breaks inside quotes."""
    csv.field_size_limit(1 << 30)
    for pdf in batches:
        for path, sep in zip(pdf["path"], pdf["sep"]):
            with open_stream(path) as f:
                rows = csv.reader(codecs.getreader("utf-8-sig")(io.BufferedReader(f), "replace"), delimiter=sep)
                next(rows, None)
                some: list[list[str]] = []
                for row in rows:
                    some.append(row)
                    if len(some) == 1024:
                        yield pd.DataFrame({"path": path, "cells": some})
                        some = []
                yield pd.DataFrame({"path": [path] * len(some), "cells": some})


def _csv_vote(t: Column) -> Column:
    return (F.when(t.isNull() | (t == ""), 0).when(t.rlike(_INTEGER), INTEGER).when(t.rlike(_DOUBLE), DOUBLE)
            .when(F.lower(t).isin("true", "false"), BOOLEAN).otherwise(_text_vote(t)))


def csv_votes(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """(path, pos, field, votes) of the columns of CSV files with a header."""
    heads = files.mapInPandas(_heads, "path string, sep string, head string, header array<string>")
    heads = heads.withColumn("width", F.size("header"))
    found = heads.agg(F.max("width").alias("width"), F.collect_set("sep").alias("seps")).first()
    width = found["width"] or 0
    if not width:
        return spark.createDataFrame([], "path string, pos int, field string, votes int")
    lines = text_lines(spark, files, roots).join(heads.select("path", "sep", "head"), "path")
    lines = lines.where((F.trim("value") != "") & (_unmarked("value") != F.coalesce("head", F.lit(""))))
    ddl = ", ".join(f"c{i} string" for i in range(width))
    cells = None
    for sep in found["seps"]:
        parsed = F.from_csv("value", ddl, {"sep": sep, "escape": '"'})
        some = F.array(*[parsed[f"c{i}"] for i in range(width)])
        cells = F.when(F.col("sep") == sep, some) if cells is None else cells.when(F.col("sep") == sep, some)
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    rows = lines.select("path", cells.alias("cells"), odd.alias("odd"))
    votes = [F.bit_or(F.coalesce(_csv_vote(F.get("cells", F.lit(i))), F.lit(0))).alias(f"v{i}") for i in range(width)]
    per = rows.groupBy("path").agg(F.bool_or("odd").alias("odd"), *votes)
    broken = heads.join(per.where("odd").select("path"), "path", "left_semi").select("path", "sep")
    again = broken.mapInPandas(_streamed, "path string, cells array<string>").groupBy("path").agg(*votes)
    joined = per.where(~F.col("odd")).drop("odd").unionByName(again)
    listed = heads.join(joined, "path", "left").select("path", "header", F.array(*[F.coalesce(f"v{i}", F.lit(0)) for i in range(width)]).alias("v"))
    out = listed.select("path", "v", F.posexplode("header").alias("pos", "field"))
    return out.select("path", "pos", "field", F.get("v", F.col("pos")).cast("int").alias("votes"))


def type_name(votes: Column) -> Column:
    """The narrowest type that holds what voted; nothing but nulls is text."""
    def only(bits: int) -> Column:
        return (votes != 0) & (votes.bitwiseAND(F.lit(~bits)) == 0)
    return (F.when(only(INTEGER), "bigint").when(only(INTEGER | DOUBLE), "double").when(only(BOOLEAN), "boolean")
            .when(only(DATE), "date").when(only(DATE | TIMESTAMP), "timestamp").when(only(NESTED), "json").otherwise("varchar"))


def text_schemas(spark: SparkSession, catalog: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(path, pos, field, raw_type) of every CSV and JSON file of ``catalog``."""
    root = roots or [common_folder(catalog)]
    if root == [None]:
        return spark.createDataFrame([], "path string, pos int, field string, raw_type string")
    jsons = json_votes(json_records(spark, of_format(catalog, "json"), root))
    both = csv_votes(spark, of_format(catalog, "csv"), root).unionByName(jsons.select("path", "pos", "field", "votes"))
    return both.select("path", "pos", "field", type_name(F.col("votes")).alias("raw_type"))
