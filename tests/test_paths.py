"""Path metadata and folder operators by examples."""

import datetime as dt

from pyspark.sql import functions as F

from lakeshore.functions.core import path_metadata
from lakeshore.operators import catalog as cat


DAY = dt.date(2024, 1, 1)
#: Path -> (source, period, date).
META = {
    "2024-01-01/x.csv": (None, None, DAY),
    "/2024-01-01": ("/", None, DAY),
    "/a/2024-02-30/20240101/f": ("a", "20240101", None),
    "/a/b/c.parquet": (None, None, None),
    "rel/src/2023-12-31/1234/f": ("src", "1234", dt.date(2023, 12, 31)),
    "/a/s/2024-01-01/202401/f.csv": ("s", "202401", DAY),
    "/a/s/2024-01-01/20240/f.csv": ("s", None, DAY),
    "/a/s/2024-01-01/2024-02-02/f.csv": ("s", None, DAY),
    "/a/s/2024-1-01/2024-01-01/2024": ("2024-1-01", "2024", DAY),
    "/s/x2024-01-01/2024-01-01y/f": (None, None, None),
}


def test_path_metadata(spark):
    df = spark.createDataFrame([(p,) for p in META], "path string")
    assert {r.path: tuple(r.m) for r in df.select("path", path_metadata("path").alias("m")).collect()} == META


def test_folder_check_with_dirs(spark):
    catalog = spark.createDataFrame([("/r/valid/2026-03-18/f.csv",), ("/r/other/x",)], "path string")
    expected = spark.createDataFrame([(1, " valid"), (2, "lost_1"), (3, "lost_2"), (4, "empty"), (5, ""), (6, "valid")],
                                     "ord long, folder string")
    dirs = spark.createDataFrame([("empty",)], "folder string")
    got = {r.folder: r.status for r in cat.folder_check(expected, catalog, "/r", dirs=dirs).collect()}
    assert got == {"valid": "found", "lost_1": "missing", "lost_2": "missing", "empty": "empty"}
    dates = cat.max_date_per_folder(catalog, "/r").select(F.substring("folder", 4, 100).alias("folder"), "max_date")
    rep = cat.folder_report(cat.folder_check(expected, catalog, "/r", dirs=dirs), dates).first()
    assert (rep.missing, rep.empty, rep.found, rep.total_checked) == (2, 1, 1, 4)
    assert rep.newest_date == "2026-03-18" and not rep.success


def test_hidden_entries_skipped(spark):
    catalog = spark.createDataFrame([("/r/.hid/abc.txt",), ("/r/abc/x.txt",)], "path string")
    got = [r.path for r in cat.search_names(catalog, "/r", "ABC").collect()]
    assert got == ["/r/abc"]
