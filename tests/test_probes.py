"""Inputs on which results went wrong before: replays, null keys, mixed
folders, long and odd files, many parts, empty requests."""

import json

import pytest
from pyspark.sql import functions as F

from lakeshore.operators import catalog, folders, links, scan, split
from lakeshore.session import scratch_dir
from lakeshore.sources import files, sinks, streams
from lakeshore.streaming import jobs


def _records(spark, path, rows):
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long")
    df.coalesce(1).write.mode("append").json(path)


def test_part_numbers_beyond_999(spark):
    parts = split.number_parts(spark.range(1200).select(F.lit("k").alias("k"), F.format_string("f%05d", "id").alias("path")), ["k"], "path")
    rows = parts.orderBy("path").collect()
    assert [r["part_no"] for r in rows] == list(range(1, 1201))
    assert rows[4]["part"] == "005" and rows[1004]["part"] == "1005" and len({r["part"] for r in rows}) == 1200


def test_split_without_known_size_needs_a_cap(spark):
    with pytest.raises(ValueError, match="max_records"):
        split.split_by_columns(spark.range(3).withColumn("k", F.lit("a")), scratch_dir(spark, "t"), "k")


def test_bad_codes_are_counted(spark):
    rows = [("a", "0", "0"), ("a", "x", "0"), ("a", None, "0"), ("b", "0", "y"), ("b", "z", "z")]
    got = split.bad_code_counts(spark.createDataFrame(rows, "dataset_checksum string, mos_code string, mot_code string"))
    assert {r["dataset_checksum"]: r["bad_codes"] for r in got.collect()} == {"a": 1, "b": 2}


def test_empty_folder_request_is_an_error(spark):
    checked = spark.createDataFrame([], "folder string, ord int, status string")
    dates = spark.createDataFrame([], "folder string, max_date string")
    r = catalog.folder_report(checked, dates).first()
    assert not r["success"] and r["total_checked"] == 0 and r["message"] == "no folders requested"


def test_messages_without_key_stay_apart(spark):
    src = scratch_dir(spark, "nokey")
    body = json.dumps({"a": 1})
    _records(spark, src, [(None, body, "t", 0, 1), (None, body, "t", 1, 1), ("k", body, "t", 0, 2), ("k", json.dumps({"a": 2}), "t", 1, 3)])
    table = scratch_dir(spark, "table")
    jobs.upsert_stream(jobs.read_records(spark, path=src), table, scratch_dir(spark, "ck"))
    got = {r["key"]: r["value"] for r in jobs.read_latest(spark, table, ["key"]).collect()}
    assert len(got) == 3 and got["k"] == json.dumps({"a": 2})


def test_replayed_batch_leaves_each_message_in_one_output(spark, monkeypatch):
    batches = []
    monkeypatch.setattr(jobs, "_batch_writer", lambda fn, df, ck, mode="append": batches.append(fn))
    ok, retry, dlq, bad = (scratch_dir(spark, p) for p in ("ok", "retry", "dlq", "bad"))

    def handler(df):
        err = F.when((F.col("attempt") == 1) & (F.col("key") < "5"), F.lit("once")).when(F.col("key") == "9", F.lit("always"))
        return df.withColumn("error", err)

    jobs.retry_then_dlq(spark.createDataFrame([], jobs.RECORD_SCHEMA), handler, ok, retry, dlq, bad, "", max_retries=1,
                        clock=lambda b: b * 1000.0)
    run = batches[0]
    rows = [(str(i), json.dumps({"i": i}), "t", 0, i) for i in range(10)] + [("x", "{not json", "t", 0, 99)]
    first = spark.createDataFrame(rows, jobs.RECORD_SCHEMA)
    none = spark.createDataFrame([], jobs.RECORD_SCHEMA)
    for batch, n in ((first, 0), (none, 1), (none, 1), (none, 2)):      # batch 1 is replayed
        run(batch, n)
    done = sorted(r["key"] for r in spark.read.parquet(ok).collect())
    dead = [r["key"] for r in spark.read.parquet(dlq).collect()]
    assert done == [str(i) for i in range(9)] and dead == ["9"]
    assert spark.read.parquet(bad).count() == 1
    assert spark.read.parquet(f"{retry}/batch=2").count() == 0


def test_folders_with_mixed_schemas_and_stray_files(spark):
    root, temp = scratch_dir(spark, "mixed"), scratch_dir(spark, "temp")
    base = spark.range(10).withColumn("k", F.lit("a"))
    base.coalesce(1).write.parquet(f"{root}/E/1")
    base.withColumn("extra", F.lit("x")).coalesce(1).write.parquet(f"{root}/E/2")
    spark.createDataFrame([("t",)], "value string").coalesce(1).write.text(f"{root}/E/3")
    fs, path, jvm = sinks._fs(spark, f"{root}/E/1")
    part = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")][0]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    copy = jvm.org.apache.hadoop.fs.FileUtil.copy
    copy(fs, part, fs, jvm.org.apache.hadoop.fs.Path(f"{root}/E/1/copy.parquet.bak"), False, conf)
    copy(fs, part, fs, jvm.org.apache.hadoop.fs.Path(f"{root}/E/2/sent.parquet.sended"), False, conf)
    tasks = spark.createDataFrame([(f"t{i}", f"E/{i}", ["k"]) for i in (1, 2, 3, 4)],
                                  "task_id string, folder string, split_columns array<string>")
    res, _ = folders.process_folders(spark, tasks, root, temp, ["E"], max_records=100)
    got = {r["task_id"]: (r["status"], r["total_rows"]) for r in res.collect()}
    assert got == {"t1": ("completed", 10), "t2": ("completed", 20), "t3": ("empty", 0), "t4": ("error", 0)}
    out = [spark.read.parquet(f"{temp}/{d}") for d in sinks.list_dirs(spark, temp)]
    assert sorted(sorted(c for c in d.columns if not c.startswith("_k_")) for d in out) == [["extra", "id", "k"], ["id", "k"]]
    assert not any("_task" in d.columns for d in out)


def _write(spark, path, data):
    fs, p, _ = sinks._fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def test_row_counts_of_arrays_and_quoted_breaks(spark):
    root = scratch_dir(spark, "counts")
    _write(spark, f"{root}/pretty.json", json.dumps([{"a": i} for i in range(3)], indent=2).encode())
    _write(spark, f"{root}/line.json", json.dumps([{"a": i} for i in range(4)]).encode())
    _write(spark, f"{root}/lines.jsonl", b'{"a":1}\n\n{"a":2}\n')
    _write(spark, f"{root}/quoted.csv", b'a,b\n1,"x\ny"\n2,"say ""hi""\nthere"\n')
    _write(spark, f"{root}/broken.parquet", b"not a parquet file")
    got = {r["name"]: r["rows"] for r in files.row_counts(spark, files.file_catalog(spark, root)).collect()}
    assert got == {"pretty.json": 3, "line.json": 4, "lines.jsonl": 2, "quoted.csv": 2, "broken.parquet": None}


def test_encoding_is_that_of_the_whole_file(spark):
    root = scratch_dir(spark, "enc")
    text = "a;b\n" + "".join(f"{i};{'x' * (i % 3)}привет\n" for i in range(6000))
    _write(spark, f"{root}/utf8.csv", text.encode())
    _write(spark, f"{root}/cp1251.csv", "a,b\n1,мир\n".encode("cp1251"))
    rows = files.scan_csv_as_text(spark, root).collect()
    assert len(rows) == 6001 and sum("привет" in r["b"] for r in rows) == 6000 and sum(r["b"] == "мир" for r in rows) == 1


def test_layout_is_decided_per_file(spark):
    root = scratch_dir(spark, "layout")
    _write(spark, f"{root}/a.csv", b"a,b\n1,2\n")
    _write(spark, f"{root}/b.csv", b"a;b\n3;4\n")
    assert sorted(tuple(r) for r in files.scan_csv(spark, root).collect()) == [(1, 2), (3, 4)]
    root = scratch_dir(spark, "layout")
    _write(spark, f"{root}/a.json", b'[\n{"a": 1},\n{"a": 2}\n]')
    _write(spark, f"{root}/b.json", b'{"a": 3}\n{"a": 4}\n')
    assert sorted(r["a"] for r in files.scan_json(spark, root).collect()) == [1, 2, 3, 4]


def test_types_of_mixed_layouts_are_widened(spark):
    root = scratch_dir(spark, "widened")
    _write(spark, f"{root}/a.csv", b"k,v\n007,1\n2,3\n")
    _write(spark, f"{root}/b.csv", b"k;v\nx;1.5\ny;2\n")
    assert sorted(tuple(r) for r in files.scan_csv(spark, root).collect()) == [("007", 1.0), ("2", 3.0), ("x", 1.5), ("y", 2.0)]


def test_json_object_over_several_lines(spark):
    root = scratch_dir(spark, "json-object")
    _write(spark, f"{root}/a.json", b'{\n"a": 1,\n"b": {"c": 0.5}\n}\n')
    assert [(r["a"], r["b"]["c"]) for r in files.scan_json(spark, root).collect()] == [(1, 0.5)]
    _write(spark, f"{root}/b.jsonl", b'{"a": 2}\n{"a": 3, "b": {"c": 2.0}, "d": "x"}\n')
    got = sorted((r["a"], r["b"] and r["b"]["c"], r["d"]) for r in files.scan_json(spark, root).collect())
    assert got == [(1, 0.5, None), (2, None, None), (3, 2.0, "x")]
    counts = {r["name"]: r["rows"] for r in files.row_counts(spark, files.file_catalog(spark, root)).collect()}
    assert counts == {"a.json": 1, "b.jsonl": 2}


def test_links_without_id_are_not_lost(spark):
    c = spark.createDataFrame([(None, "http://a.com"), (None, "http://b.com"), (5, "http://B.com"), (None, None)], "id long, url string")
    none = spark.createDataFrame([], "url_normalized string")
    status = {(r["id"], r["url"]): r["status"] for r in links.new_links(c, none).collect()}
    assert status == {(None, "http://a.com"): "new", (None, "http://b.com"): "duplicate", (5, "http://B.com"): "new", (None, None): "new"}
    rows = {(r["id"], r["url"]) for r in links.insert_new(c, none).collect()}
    assert rows == {(None, "http://a.com"), (5, "http://B.com"), (None, None)}


def test_unknown_store_is_an_error():
    for path in ("dbfs:/x", "hdfs:/x"):
        with pytest.raises(ValueError):
            streams.filesystem(path)
    assert streams.filesystem("file:/tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError):
        streams.filesystem("odd://bucket/x")


def test_partitioned_jdbc_options():
    assert files.jdbc_split("id", 0, 100, 8) == {"column": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 8}
    assert files.jdbc_split(None, None, None, None) == {}
    with pytest.raises(ValueError):
        files.jdbc_split("id", None, None, 8)


def test_batch_messages_carry_key_and_partition(spark):
    path = scratch_dir(spark, "msgs")
    df = spark.range(4).select("id", (F.col("id") % 2).alias("p"))
    sinks.write_messages(df, "t", sink="json", path=path, key_col="id", partition_col="p")
    got = sorted((r["key"], r["partition"]) for r in spark.read.json(path).collect())
    assert got == [("0", 0), ("1", 1), ("2", 0), ("3", 1)]


def test_files_of_a_source_may_differ(spark):
    root = scratch_dir(spark, "differ")
    base = spark.range(6).select((F.col("id") % 2).cast("int").alias("k1"), F.col("id").alias("v"))
    base.coalesce(1).write.parquet(f"{root}/s/2024-01-01/202401")
    base.withColumn("k2", F.lit("x")).coalesce(1).write.parquet(f"{root}/s/2024-01-02/202401")
    base.select(F.col("k1").cast("string"), F.lit(2.5).alias("k2")).coalesce(1).write.parquet(f"{root}/s/2024-01-03/202401")
    base.select("v").coalesce(1).write.parquet(f"{root}/t/2024-01-03/202401")

    def facts(config):
        out = {}
        for r in scan.scan_registry(spark, root, config=config, extensions="parquet").collect():
            v = json.loads(r["validation"])
            out[r["name"], str(r["upload_date"])[-2:]] = v.get("split_combinations"), v.get("distinct_values")
        return out
    got = facts({"s": {"split_columns": ["k1", "k2"]}, "t": ["v", "none"]})
    assert got["s", "01"] == (None, None)
    assert got["s", "02"] == ([["0", "x"], ["1", "x"]], None)
    assert got["s", "03"] == ([["0", "2.5"], ["1", "2.5"]], None)
    assert got["t", "03"] == (None, {"v": ["0", "1", "2", "3", "4", "5"]})
    got = facts({"s": ["k1", "k2"]})
    assert got["s", "01"][1] == {"k1": ["0", "1"]} and got["s", "02"][1] == {"k1": ["0", "1"], "k2": ["x"]}


def test_a_folder_belongs_to_every_task_that_names_it(spark):
    root, temp = scratch_dir(spark, "own"), scratch_dir(spark, "temp")
    base = spark.range(10).withColumn("k", F.lit("a"))
    base.coalesce(1).write.parquet(f"{root}/E/1")
    base.coalesce(1).write.parquet(f"{root}/E/1/inner")
    base.coalesce(1).write.parquet(f"{root}/E/10")
    tasks = spark.createDataFrame([("a", "E/1", ["k"]), ("b", "E/1/", ["k"]), ("c", "E/1/inner", ["k"]), ("d", "E/10", ["k"])],
                                  "task_id string, folder string, split_columns array<string>")
    res, _ = folders.process_folders(spark, tasks, root, temp, ["E"], max_records=100)
    assert {r["task_id"]: (r["status"], r["total_rows"]) for r in res.collect()} == {
        "a": ("completed", 20), "b": ("completed", 20), "c": ("completed", 10), "d": ("completed", 10)}


def test_folder_tree_has_empty_folders(spark):
    root = scratch_dir(spark, "tree-test")
    _write(spark, f"{root}/a/b/x.csv", b"1")
    fs, path, jvm = sinks._fs(spark, f"{root}/a/empty/inner")
    fs.mkdirs(path)
    got = {(r["path"][len(root) + 1:], r["is_dir"], r["length"]) for r in files.folder_tree(spark, root).collect() if not r["path"].endswith(".crc")}
    assert got == {("a", True, 0), ("a/b", True, 0), ("a/b/x.csv", False, 1), ("a/empty", True, 0), ("a/empty/inner", True, 0)}
    assert files.folder_tree(spark, f"{root}/nowhere").collect() == []
