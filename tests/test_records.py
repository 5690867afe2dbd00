"""Field types and records of text files."""

import os

import pytest
from pyspark.sql import functions as F

from lakeshore.operators import schema as sc
from lakeshore.sources import files as src
from lakeshore.sources import records


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__", "/").replace("_DOT_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return str(tmp_path)
    return write


def types(spark, root):
    out = {}
    for r in sc.extract_schema(src.file_catalog(spark, root)).orderBy("path", "pos").collect():
        out.setdefault(os.path.basename(r.path), []).append((r.field, r.type))
    return out


def test_csv_types_join_over_all_rows(spark, folder):
    lines = "\n".join(f"{i},{i},{i % 2 == 0},2024-01-{i % 28 + 1:02d},2024-01-01 10:00:{i % 60:02d},x{i},," for i in range(3000))
    root = folder(a_DOT_csv=f"i,d,b,day,ts,t,none,big\n{lines}\n7,2.5,true,2024-02-30,2024-01-01,y,,99999999999999999999\n",
                  b_DOT_txt="k;v\n1;2024-01-01\n;2024-01-02 00:00:00\n", c_DOT_csv="only\n", d_DOT_csv="",
                  e_DOT_tsv='q\tn\n"a ""b"""\t1\n', f_DOT_csv='q,n\n"two\nlines, 1",1\n"x",2\n', g_DOT_csv_DOT_sended="i\n5\n")
    got = types(spark, root)
    assert got["a.csv"] == [("i", "BIGINT"), ("d", "DOUBLE PRECISION"), ("b", "BOOLEAN"), ("day", "VARCHAR"), ("ts", "TIMESTAMP"),
                            ("t", "VARCHAR"), ("none", "VARCHAR"), ("big", "DOUBLE PRECISION")]
    assert got["b.txt"] == [("k", "BIGINT"), ("v", "TIMESTAMP")]
    assert got["c.csv"] == [("only", "VARCHAR")]
    assert got["e.tsv"] == [("q", "VARCHAR"), ("n", "BIGINT")]
    assert got["f.csv"] == [("q", "VARCHAR"), ("n", "BIGINT")]
    assert got["g.csv.sended"] == [("i", "BIGINT")]


def test_json_types_lines_arrays_and_documents(spark, folder):
    root = folder(a_DOT_json='{"b": 1, "a": "x"}\n{"b": 2.5, "c": {"d": 1}}\n', b_DOT_json='[{"a": true},\n {"a": false, "z": null}]',
                  c_DOT_jsonl='{\n "a": 1,\n "t": "2024-01-01"\n}\n', d_DOT_ndjson='{"a": 1}\n{"a": "one"}\n', e_DOT_json='no json\n')
    got = types(spark, root)
    assert got["a.json"] == [("a", "VARCHAR"), ("b", "DOUBLE PRECISION"), ("c", "JSON")]
    assert got["b.json"] == [("a", "BOOLEAN"), ("z", "VARCHAR")]
    assert got["c.jsonl"] == [("a", "BIGINT"), ("t", "DATE")]
    assert got["d.ndjson"] == [("a", "VARCHAR")]
    assert got["e.json"] == [(None, "UNKNOWN")]


def test_votes_merge_in_any_order(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") == 4321, "1.5").otherwise(F.col("id").cast("string")).alias("v"))
    rows.write.option("header", True).csv(str(tmp_path / "x"))
    spark.read.option("header", True).csv(str(tmp_path / "x")).coalesce(1).write.option("header", True).csv(str(tmp_path / "y"))
    got = types(spark, str(tmp_path))
    assert sorted(t for f in got.values() for _, t in f).count("DOUBLE PRECISION") == 2   # the part with 1.5, and the whole


def test_only_the_files_of_the_catalog(spark, folder):
    root = folder(in__a_DOT_csv="x\n1\n", in__b_DOT_csv="y\n1\n")
    catalog = src.file_catalog(spark, root).where(F.col("path").endswith("a.csv"))
    assert [r.field for r in sc.extract_schema(catalog, [root]).collect()] == ["x"]


def test_empty_catalog(spark, folder):
    root = folder(a_DOT_csv="x\n1\n")
    assert sc.extract_schema(src.file_catalog(spark, root).where("false")).collect() == []


def test_common_folder(spark):
    paths = spark.createDataFrame([("/a/b/c/1",), ("/a/b/d/2",), ("/a/b/c/x/3",)], "path string")
    assert records.common_folder(paths) == "/a/b"
    assert records.common_folder(paths.where("path = '/a/b/c/1'")) == "/a/b/c"


def test_name_rules_are_tested_per_file_not_per_line(spark, folder):
    """Joins on the path must not carry the filter of the files over to the lines."""
    root = folder(a_DOT_json='{"a": 1}\n{"a": 2}\n', b_DOT_csv="x\n1\n2\n3\n")
    catalog = src.file_catalog(spark, root)
    jsons = records.of_format(catalog, "json")

    def rules(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")
    lines = records.text_lines(spark, jsons, [root])
    assert rules(lines) == rules(jsons) > 0
    rows = src._per_file(spark.read.option("header", True).csv(f"{root}/b.csv"))
    csvs = records.of_format(catalog, "csv")
    assert rules(records.of_files(rows, csvs)) == rules(csvs)
    got = {os.path.basename(r.path): r.rows for r in src.row_counts(spark, catalog).collect()}
    assert got == {"a.json": 2, "b.csv": 3} and lines.count() == 2
