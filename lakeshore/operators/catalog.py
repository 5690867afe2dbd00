"""Operators over a file catalog (path per row): listings, searches, folder
checks and date folders (B7, B8, C8, D11, D12, D14, G2, H13, J8).

Folders are derived from file paths (every ancestor of a file), so a
catalog of millions of files is processed as a distributed explode +
distinct.  Folders without files come from ``folder_tree``, which walks a
root level by level inside tasks; nothing walks it on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.functions.paths import ancestors, strip_suffix
from lakeshore.sources.files import folder_tree

DATE_RE = r"^\d{4}-\d{2}-\d{2}$"


def entries(catalog: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """Files and folders below ``root``: path, name, parent, is_dir."""
    root = root.rstrip("/")
    files = catalog.select(F.col(path_col).alias("path"), F.lit(False).alias("is_dir"))
    dirs = (catalog.select(F.explode(ancestors(F.col(path_col))).alias("path"))
            .distinct().select("path", F.lit(True).alias("is_dir")))
    both = files.unionByName(dirs).where(F.col("path").startswith(root + "/"))
    return both.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
                       F.regexp_replace("path", r"/[^/]*$", "").alias("parent"), "is_dir",
                       F.substring("path", len(root) + 2, 1 << 30).alias("rel"))


def not_hidden(rel: Column) -> Column:
    return ~F.exists(F.split(rel, "/"), lambda x: x.startswith("."))


def search_names(catalog: DataFrame, root: str, text: str) -> DataFrame:
    """Case-insensitive substring on the name; entries under a hidden
    part skipped; folders first, then by lower-case name."""
    e = entries(catalog, root)
    hit = e.where(F.lower("name").contains(text.lower()) & not_hidden(F.col("rel")))
    return hit.orderBy(F.col("is_dir").desc(), F.lower("name"), "path")


def match_names(catalog: DataFrame, root: str, pattern: str) -> DataFrame:
    """Regular-expression search (ignore case) on the name."""
    e = entries(catalog, root)
    hit = e.where(F.col("name").rlike("(?i)" + pattern) & not_hidden(F.col("rel")))
    return hit.orderBy(F.col("is_dir").desc(), F.lower("name"), "path")


def folders_with_files(catalog: DataFrame, extensions="*", path_col: str = "path") -> DataFrame:
    """Sorted distinct parent folders of matching files; '*' means a
    name with a dot; extensions match case-sensitively as a suffix."""
    name = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)
    if extensions == "*":
        cond = name.contains(".")
    else:
        exts = extensions.split(",") if isinstance(extensions, str) else list(extensions)
        cond = None
        for e in exts:
            c = name.endswith("." + e.strip())
            cond = c if cond is None else cond | c
    return (catalog.where(cond).select(F.regexp_replace(path_col, r"/[^/]*$", "").alias("parent"))
            .distinct().orderBy("parent"))


def ordered_distinct(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(col).agg(F.min(order).alias("first")).orderBy("first")


def date_children(catalog: DataFrame, root: str, pattern: str = DATE_RE) -> DataFrame:
    """(folder, name) of every folder whose name matches ``pattern``."""
    d = entries(catalog, root).where(F.col("is_dir") & F.col("name").rlike(pattern))
    return d.select(F.col("parent").alias("folder"), "name")


def max_date_per_folder(catalog: DataFrame, root: str, folders: DataFrame | None = None) -> DataFrame:
    """Newest valid YYYY-MM-DD child folder per folder (null if none)."""
    kids = date_children(catalog, root).where(F.try_to_date("name", "yyyy-MM-dd").isNotNull())
    best = kids.groupBy("folder").agg(F.max("name").alias("max_date"))
    if folders is None:
        return best
    return folders.join(best, "folder", "left")


def dates_in_folder(catalog: DataFrame, root: str, pattern: str = DATE_RE) -> DataFrame:
    """Sorted distinct date-like folder names per folder, and their number."""
    kids = date_children(catalog, root, pattern).distinct()
    return kids.groupBy("folder").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("dates"),
                                      F.count(F.lit(1)).alias("total"))


def folder_check(expected: DataFrame, catalog: DataFrame, root: str, folder_col: str = "folder",
                 order_col: str = "ord", dirs: DataFrame | None = None) -> DataFrame:
    """Expected folder names (trimmed, blanks dropped, first occurrence
    kept) -> found (a file somewhere below), empty (folder known but no
    file; needs ``dirs``), missing."""
    root = root.rstrip("/")
    exp = (expected.select(F.trim(F.col(folder_col)).alias("folder"), F.col(order_col).alias("ord"))
           .where(F.col("folder").isNotNull() & (F.col("folder") != ""))
           .groupBy("folder").agg(F.min("ord").alias("ord")))
    with_files = (catalog.select(F.explode(ancestors(F.col("path"))).alias("p"))
                  .where(F.col("p").startswith(root + "/"))
                  .select(F.substring("p", len(root) + 2, 1 << 30).alias("folder")).distinct()
                  .withColumn("_files", F.lit(True)))
    out = exp.join(with_files, "folder", "left")
    status = F.when(F.col("_files"), F.lit("found"))
    if dirs is not None:
        known = dirs.select(F.col("folder")).distinct().withColumn("_dir", F.lit(True))
        out = out.join(known, "folder", "left")
        status = status.when(F.col("_dir"), F.lit("empty"))
    return out.select("folder", "ord", status.otherwise(F.lit("missing")).alias("status"))


def folder_check_listing(spark: SparkSession, expected: DataFrame, root: str, folder_col: str = "folder",
                         order_col: str = "ord") -> DataFrame:
    """C8 on a real folder: ``root`` is walked, so folders without files are ``empty``."""
    tree = folder_tree(spark, root)
    return folder_check(expected, tree.where(~F.col("is_dir")), root, folder_col, order_col, relative_dirs(tree, root))


def relative_dirs(tree: DataFrame, root: str) -> DataFrame:
    """The folders of a tree by their path below ``root``."""
    return tree.where("is_dir").select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30).alias("folder"))


def folder_report(checked: DataFrame, dates: DataFrame) -> DataFrame:
    """One summary row: counts, success flag and the message text; an
    empty request is an error."""
    found_dates = checked.join(dates, "folder", "left")
    agg = found_dates.agg(
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "found").alias("found"),
        F.count(F.lit(1)).alias("total_checked"),
        F.max(F.when(F.col("status") == "found", F.col("max_date"))).alias("newest_date"))
    parts = F.array(
        F.when(F.col("missing") > 0, F.format_string("not found: %d", F.col("missing"))),
        F.when(F.col("empty") > 0, F.format_string("empty: %d", F.col("empty"))),
        F.when(F.col("found") > 0, F.format_string("with files: %d", F.col("found"))))
    msg = F.array_join(F.filter(parts, lambda x: x.isNotNull()), " | ")
    return agg.select("*", ((F.col("total_checked") > 0) & (F.col("missing") == 0) & (F.col("empty") == 0)).alias("success"),
                      F.when(F.col("total_checked") == 0, F.lit("no folders requested")).when(msg == "", F.lit("no data")).otherwise(msg).alias("message"))


def strip_state_suffix(catalog: DataFrame, ext: str, suffix: str = ".sended") -> DataFrame:
    """H13 on a catalog: the target name of each ``*.ext<suffix>`` file,
    ``renamed`` false when the target already exists."""
    target = strip_suffix(F.col("path"), ext, suffix)
    cands = catalog.select("path", target.alias("target")).where(F.col("target").isNotNull())
    existing = catalog.select(F.col("path").alias("target")).withColumn("_exists", F.lit(True))
    return (cands.join(existing, "target", "left")
            .select("path", "target", F.col("_exists").isNull().alias("renamed")))
