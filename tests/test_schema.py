"""Schema operators by examples."""

import datetime as dt
import decimal
import json

from pyspark.sql import functions as F

from lakeshore.functions.types import COMPATIBLE_TYPES, normalize_type, type_compatible
from lakeshore.operators import schema as sc

# Type name -> canonical name in the dialects parquet, postgresql, duckdb, mysql.
TYPE_EXAMPLES = {
    "varchar[]": ("VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"),
    "integer[]": ("INTEGER[]", "INTEGER", "INTEGER", "INTEGER[]"),
    "decimal(18,3)": ("DECIMAL", "DECIMAL", "DECIMAL", "DECIMAL"),
    "timestamp_ns": ("TIMESTAMP", "TIMESTAMP", "TIMESTAMP", "TIMESTAMP"),
    "hugeint": ("HUGEINT", "HUGEINT", "HUGEINT", "HUGEINT"),
    "struct(a varchar)": ("VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"),
    "date32[day]": ("DATE32[DAY]", "DATE", "DATE", "DATE"),
    "timestamp[us, tz=Europe/Moscow]": ("TIMESTAMP", "TIMESTAMP", "TIMESTAMP", "TIMESTAMP"),
    "": ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"),
    "  ": ("", "", "", ""),
    "character varying(20)": ("VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"),
    "Double Precision": ("DOUBLE PRECISION", "DOUBLE PRECISION", "DOUBLE PRECISION", "DOUBLE PRECISION"),
    "int64": ("BIGINT", "INT64", "INT64", "INTEGER"),
    "TEXT": ("TEXT", "TEXT", "TEXT", "TEXT"),
    "numeric": ("DECIMAL", "DECIMAL", "DECIMAL", "DECIMAL"),
    "timestamp with time zone": ("TIMESTAMPTZ", "TIMESTAMPTZ", "TIMESTAMPTZ", "TIMESTAMPTZ"),
    "bpchar(3)": ("VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"),
}
# (from, to) -> may a column of the first type go into one of the second?
COMPATIBLE_EXAMPLES = {
    ("SMALLINT", "BIGINT"): True, ("INTEGER", "BIGINT"): True, ("BIGINT", "SMALLINT"): False, ("DATE", "TIMESTAMP"): True,
    ("BOOLEAN", "INTEGER"): True, ("HUGEINT", "HUGEINT"): False, ("INT64", "INT64"): False,
    ("VARCHAR(20)", "TEXT"): True, ("decimal(18,3)", "DECIMAL(10,2)"): True, ("JSON", "DATE"): False,
}


def test_normalize_type_edge(spark):
    df = spark.createDataFrame([(t,) for t in TYPE_EXAMPLES], "t string")
    for i, dialect in enumerate(("parquet", "postgresql", "duckdb", "mysql")):
        got = {r["t"]: r["n"] for r in df.select("t", normalize_type(F.col("t"), dialect).alias("n")).collect()}
        assert got == {t: n[i] for t, n in TYPE_EXAMPLES.items()}, dialect


def test_compatibility(spark):
    df = spark.createDataFrame(list(COMPATIBLE_EXAMPLES), "a string, b string")
    got = {(r["a"], r["b"]): r["ok"] for r in df.select("a", "b", type_compatible(F.col("a"), F.col("b")).alias("ok")).collect()}
    assert got == COMPATIBLE_EXAMPLES


def test_every_listed_pair_is_compatible(spark):
    pairs = [(a, b) for a, to in COMPATIBLE_TYPES.items() for b in to]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~type_compatible(F.col("a"), F.col("b"))).count() == 0


def test_load_schema_layouts(spark):
    docs = [(1, json.dumps({"a": "int", "b": "text"})), (2, json.dumps({"schema": {"a": "int"}})),
            (3, json.dumps({"columns": [{"name": "a", "type": "int"}]})),
            (4, json.dumps({"fields": [{"name": "x", "type": "uuid"}, {"name": "y", "type": "date"}]})),
            (5, "not json")]
    df = spark.createDataFrame(docs, "schema_id long, doc string")
    got = sorted(tuple(r) for r in sc.load_schema(df).collect())
    assert got == [(1, "a", "int"), (1, "b", "text"), (2, "a", "int"), (3, "a", "int"), (4, "x", "uuid"), (4, "y", "date")]


def test_json_safe(spark):
    rows = [(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6), decimal.Decimal("1.25"), bytearray(b"abc"),
             bytearray(b"\xff\x00"), [dt.date(2024, 2, 3)])]
    df = spark.createDataFrame(rows, "d date, ts timestamp_ntz, m decimal(10,2), b binary, nb binary, arr array<date>")
    r = sc.json_safe(df).first()
    assert r.d == "2024-01-02" and r.ts == "2024-01-02T03:04:05.000006" and r.m == 1.25
    assert r.b == "abc" and r.nb == "ff00" and r.arr == ["2024-02-03"]


def test_validate_contract(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = {r.name: r for r in sc.validate_contract(li, {"l_orderkey": "Int64", "l_returnflag": "Int64",
                                                           "missing": "String"}).collect()}
    assert out["l_orderkey"].compatible and out["l_orderkey"].failures == 0
    assert out["l_returnflag"].failures == li.count() and not out["l_returnflag"].compatible
    assert not out["missing"].present


def test_extract_schema_all_tables(spark, sf):
    from lakeshore.sources.files import file_catalog
    got = sc.extract_schema(file_catalog(spark, sf, "parquet")).where(F.col("path").endswith("/lineitem.parquet"))
    names = [r.field for r in got.orderBy("pos").collect()]
    assert names == spark.read.parquet(f"{sf}/lineitem.parquet").columns


def test_field_lists_are_grouped_in_tasks_of_bounded_rows(spark, sf, monkeypatch):
    """Memory of a task must not follow the table: more rows, more tasks."""
    from lakeshore.plans import views
    monkeypatch.setattr(views, "GROUP_ROWS", 200)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    a, b = (views.view(spark, sf, n) for n in ("src_fields", "tgt_fields"))
    got = sc.field_set_ops(a, b)
    for x in (a, b):
        assert x.rdd.getNumPartitions() >= rows // 200 and max(len(p) for p in x.rdd.glom().collect()) <= 600
    left, right = ({(r.schema_id, r.name) for r in x.collect()} for x in (a, b))
    want = {(*k, "both" if k in left and k in right else "left" if k in left else "right") for k in left | right}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_field_set_ops_takes_nulls_as_equal_and_rows_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, None)], "schema_id long, name string")
    b = spark.createDataFrame([(None, None), (1, "y"), (1, "y")], "schema_id long, name string")
    got = {tuple(r) for r in sc.field_set_ops(a, b).collect()}
    assert got == {(1, "x", "left"), (2, None, "left"), (1, "y", "right"), (None, None, "both")}
    assert sc.field_set_ops(a, b).count() == 4
