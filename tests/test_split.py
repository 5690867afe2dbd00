"""Split properties: rows are conserved, files respect the cap, keys that
look alike stay apart, and a hot key does not end up in one file."""

from pyspark.sql import functions as F

from lakeshore.operators import split as sp
from lakeshore.plans.views import view
from lakeshore.session import scratch_dir


def test_split_conserves_rows(spark, sf):
    li = view(spark, sf, "li_keys")
    res = sp.split_by_columns(li, scratch_dir(spark, "t-split"), ["k1", "k2"], max_records=100)
    kept = sp.drop_blank_keys(li, ["k1", "k2"]).count()
    assert res.total_rows == kept
    assert res.total_rows + res.dropped_rows == li.count()
    back = sp.read_split(spark, res.target).select(*li.columns)
    assert back.exceptAll(sp.drop_blank_keys(li, ["k1", "k2"])).count() == 0
    assert res.manifest.agg(F.max("rows")).first()[0] <= 100
    keys = {(r.k1, r.k2) for r in res.stats.collect()}
    assert ("US", "O") in keys or ("US", "F") in keys
    assert any(k[0] == "US_1" for k in keys) and any(k[0] == "a/b" for k in keys) and any(k[0] == "a_b" for k in keys)
    summary = sp.split_summary(res, 100).collect()
    assert all(r.within_cap and r.enough_parts for r in summary)


def test_hot_key_is_spread(spark):
    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 50).cast("string"))
                               .alias("k"), F.col("id"))
    res = sp.split_by_columns(df, scratch_dir(spark, "t-hot"), ["k"], max_records=1000)
    hot = res.manifest.where(F.col("k") == "HOT").collect()
    assert sum(r.rows for r in hot) == n // 3
    assert len(hot) >= 10 and max(r.rows for r in hot) <= 1000
    parts = sorted(r.part for r in hot)
    assert parts[0] == "001" and parts[-1] == f"{len(hot):03d}"


def test_control_sum_zero_levels(spark):
    rows = [("A", 0, 10.0, "C00", "0", "0", 0, 1), ("A", 2, 10.0, "C00", "0", "0", 0, 1),
            ("B", 0, 5.0, "C00", "0", "0", 0, 1), ("B", 4, 0.0, "C00", "0", "0", 0, 1),
            ("C", 0, 1.0, "C00", "x", "0", 0, 1)]
    df = spark.createDataFrame(rows, "dataset_checksum string, aggr_level long, primary_value double, customs_code string,"
                                     " mos_code string, mot_code string, partner2_code long, partner_code long")
    got = {r.dataset_checksum: (r.control_sum, r.row_count) for r in sp.control_sum(df).collect()}
    assert got == {"A": (0.0, 2), "B": (0.0, 2)}
    assert {r.dataset_checksum: r.bad_codes for r in sp.bad_code_counts(df).collect()} == {"A": 0, "B": 0, "C": 1}


def test_byte_budget_sets_the_cap(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cap = sp.rows_per_file(li, 16 * 1024)
    assert cap and cap < li.count()
    res = sp.split_by_columns(li, scratch_dir(spark, "t-bytes"), ["l_returnflag"], max_file_bytes=16 * 1024)
    assert res.manifest.agg(F.max("rows")).first()[0] <= cap
    assert res.total_rows == li.count() and res.dropped_rows == 0


def test_manifest_reads_no_column(spark):
    """Keys from the folder names, as they were: leading zeros, slashes, blanks
    around, the name Spark gives to null folders, numbers and dates."""
    keys = ["007", "7", "a/b", " x ", "__HIVE_DEFAULT_PARTITION__", "k=v", "ä%20"]
    df = spark.createDataFrame([(k, i % 3, f"t{i % 2}", float(i)) for i, k in enumerate(keys * 20)], "k string, n int, _task string, v double")
    res = sp.split_by_columns(df, scratch_dir(spark, "t-names"), ["_task", "k", "n"], max_records=4, folder_only=("_task",))
    scan = res.manifest._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in scan
    got = {(r["_task"], r.k, r.n): r.rows for r in res.stats.collect()}
    assert got == {(r["_task"], r.k, r.n): r["count"] for r in df.groupBy("_task", "k", "n").count().collect()}
    back = sp.read_split(spark, res.target, ("_task",))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_split_tasks_named_like_numbers(spark):
    df = spark.createDataFrame([("007", 1), ("7", 2)], "_task string, k int")
    res = sp.split_by_columns(df, scratch_dir(spark, "t-tasks"), ["_task", "k"], max_records=4, folder_only=("_task",))
    assert {r["_task"] for r in sp.read_split(spark, res.target, ("_task",)).collect()} == {"007", "7"}


def test_split_without_rows(spark):
    path = scratch_dir(spark, "t-blank-in")
    spark.createDataFrame([(None, 1), (" ", 2)], "k string, v int").write.parquet(path)
    df = spark.read.parquet(path)
    res = sp.split_by_columns(df, scratch_dir(spark, "t-blank"), ["k"], max_records=4)
    assert (res.total_rows, res.dropped_rows, res.manifest.count(), res.stats.count()) == (0, 2, 0, 0)
