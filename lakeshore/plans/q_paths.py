"""Query bindings: paths and catalog operators (B7, B8, C8, D11, D12, D14,
G2, H8-H13, J8) over the ``paths`` view (root /data/source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.functions import paths as pf
from lakeshore.functions.core import sanitize_name
from lakeshore.operators import catalog as cat
from lakeshore.operators import services as sv
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views
from lakeshore.session import scratch_dir
from lakeshore.sources.files import folder_tree

ROOT = "/data/source"

_ENTRIES = f"""
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS parent, is_dir,
  substr(path, {len(ROOT) + 2}) AS rel
FROM (SELECT path, FALSE AS is_dir FROM paths
      UNION ALL
      SELECT DISTINCT unnest(list_transform(range(2, greatest(len(string_split(path, '/')), 3)),
                                            lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path,
             TRUE AS is_dir FROM paths)
WHERE starts_with(path, '{ROOT}/')
"""
_VISIBLE = "len(list_filter(string_split(rel, '/'), lambda x: starts_with(x, '.'))) = 0"


@query("search_names", with_views(["paths"], f"""
SELECT path, name, is_dir FROM entries WHERE contains(lower(name), 'src1') AND {_VISIBLE}
""", entries=_ENTRIES))
def q_search_names(spark, sf_dir):
    return cat.search_names(view(spark, sf_dir, "paths"), ROOT, "SRC1").select("path", "name", "is_dir")


@query("match_names", with_views(["paths"], f"""
SELECT path, name, is_dir FROM entries WHERE regexp_matches(name, '^part_1[0-9]*\\.(csv|json)$', 'i') AND {_VISIBLE}
""", entries=_ENTRIES))
def q_match_names(spark, sf_dir):
    return cat.match_names(view(spark, sf_dir, "paths"), ROOT, r"^part_1[0-9]*\.(csv|json)$").select(
        "path", "name", "is_dir")


@query("folders_with_files", with_views(["paths"], """
SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS parent FROM paths
WHERE ends_with(regexp_extract(path, '([^/]*)$', 1), '.parquet') OR ends_with(regexp_extract(path, '([^/]*)$', 1), '.csv')
"""))
def q_folders_with_files(spark, sf_dir):
    return cat.folders_with_files(view(spark, sf_dir, "paths"), "parquet,csv")


@query("folders_with_any_files", with_views(["paths"], """
SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS parent FROM paths WHERE contains(regexp_extract(path, '([^/]*)$', 1), '.')
"""))
def q_folders_with_any_files(spark, sf_dir):
    return cat.folders_with_files(view(spark, sf_dir, "paths"), "*")


@query("ordered_distinct", "SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def q_ordered_distinct(spark, sf_dir):
    return cat.ordered_distinct(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id")


@query("max_date_per_folder", with_views(["paths"], """
SELECT parent AS folder, max(name) AS max_date FROM entries
WHERE is_dir AND regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$') AND try_strptime(name, '%Y-%m-%d') IS NOT NULL
GROUP BY parent
""", entries=_ENTRIES))
def q_max_date_per_folder(spark, sf_dir):
    return cat.max_date_per_folder(view(spark, sf_dir, "paths"), ROOT)


@query("dates_in_folder", with_views(["paths"], """
SELECT folder, string_agg(name, ',' ORDER BY name) AS dates, count(*) AS total
FROM (SELECT DISTINCT parent AS folder, name FROM entries WHERE is_dir AND regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$'))
GROUP BY folder
""", entries=_ENTRIES))
def q_dates_in_folder(spark, sf_dir):
    return cat.dates_in_folder(view(spark, sf_dir, "paths"), ROOT)


_CHECK = f"""
SELECT e.folder, e.ord, CASE WHEN EXISTS (SELECT 1 FROM paths p WHERE starts_with(p.path, concat('{ROOT}/', e.folder, '/')))
                             THEN 'found' ELSE 'missing' END AS status
FROM (SELECT trim(folder) AS folder, min(ord) AS ord FROM expected_folders WHERE trim(folder) <> '' GROUP BY trim(folder)) e
"""


@query("folder_check", with_views(["paths", "expected_folders"], "SELECT * FROM chk", chk=_CHECK))
def q_folder_check(spark, sf_dir):
    return cat.folder_check(view(spark, sf_dir, "expected_folders"), view(spark, sf_dir, "paths"), ROOT)


@query("folder_report", with_views(["paths", "expected_folders"], f"""
SELECT missing, empty, found, total_checked, newest_date, missing = 0 AND empty = 0 AS success,
  CASE WHEN msg = '' THEN 'no data' ELSE msg END AS message
FROM (SELECT *, array_to_string(list_filter([CASE WHEN missing > 0 THEN concat('not found: ', missing) END,
                                              CASE WHEN empty > 0 THEN concat('empty: ', empty) END,
                                              CASE WHEN found > 0 THEN concat('with files: ', found) END], lambda x: x IS NOT NULL), ' | ') AS msg
      FROM (SELECT count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'empty') AS empty,
                   count(*) FILTER (WHERE status = 'found') AS found, count(*) AS total_checked,
                   max(CASE WHEN status = 'found' THEN d.max_date END) AS newest_date
            FROM chk LEFT JOIN (SELECT substr(parent, {len(ROOT) + 2}) AS folder, max(name) AS max_date FROM entries
                                WHERE is_dir AND regexp_matches(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
                                  AND try_strptime(name, '%Y-%m-%d') IS NOT NULL GROUP BY parent) d USING (folder)))
""", chk=_CHECK, entries=_ENTRIES))
def q_folder_report(spark, sf_dir):
    paths = view(spark, sf_dir, "paths")
    checked = cat.folder_check(view(spark, sf_dir, "expected_folders"), paths, ROOT)
    dates = cat.max_date_per_folder(paths, ROOT).select(
        F.substring("folder", len(ROOT) + 2, 1 << 30).alias("folder"), "max_date")
    return cat.folder_report(checked, dates)


@query("strip_state_suffix", with_views(["paths_sended"], """
SELECT path, substr(path, 1, length(path) - 7) AS target,
  NOT EXISTS (SELECT 1 FROM paths_sended q WHERE q.path = substr(p.path, 1, length(p.path) - 7)) AS renamed
FROM paths_sended p WHERE ends_with(path, '.parquet.sended')
"""))
def q_strip_state_suffix(spark, sf_dir):
    return cat.strip_state_suffix(view(spark, sf_dir, "paths_sended"), "parquet")


@query("sanitize_name", """SELECT page_id, translate(url, '/\\:*?"<>|', '_________') AS name FROM pages""")
def q_sanitize_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", sanitize_name("url").alias("name"))


@query("after_source", with_views(["paths"], """
SELECT id, CASE WHEN strpos(p, 'source') > 0 THEN regexp_replace(substr(p, strpos(p, 'source') + 6), '^[\\\\/]', '') END AS rest,
  strpos(p, 'source') > 0 AS ok
FROM (SELECT id, CASE WHEN id % 9 = 0 THEN replace(path, 'source', 'src') ELSE path END AS p FROM paths)
"""))
def q_after_source(spark, sf_dir):
    p = view(spark, sf_dir, "paths").select(
        "id", F.expr("CASE WHEN id % 9 = 0 THEN replace(path, 'source', 'src') ELSE path END").alias("p"))
    rest = pf.after_marker("p")
    return p.select("id", rest.alias("rest"), rest.isNotNull().alias("ok"))


@query("relative_to", with_views(["paths"], """
SELECT id, CASE WHEN starts_with(path, '/data/source/src1/') THEN substr(path, 19) END AS rel,
  starts_with(path, '/data/source/src1/') AS inside
FROM paths
"""))
def q_relative_to(spark, sf_dir):
    r = pf.relative_to("path", "/data/source/src1")
    return view(spark, sf_dir, "paths").select("id", r.alias("rel"), r.isNotNull().alias("inside"))


@query("join_path", with_views(["tasks"], """
SELECT id, regexp_replace(array_to_string(list_filter(['/data/incoming', e, u, p], lambda x: x IS NOT NULL AND trim(x) <> ''), '/'), '/{2,}', '/', 'g') AS folder
FROM (SELECT id, json_extract_string(value, '$.entity') AS e, json_extract_string(value, '$.updated_at') AS u,
             json_extract_string(value, '$.period') AS p FROM tasks WHERE json_valid(value))
"""))
def q_join_path(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").where(F.expr("try_parse_json(value) IS NOT NULL"))
    g = lambda f: F.get_json_object("value", f"$.{f}")
    return t.select("id", pf.join_path(F.lit("/data/incoming"), g("entity"), g("updated_at"), g("period")).alias("folder"))


_MESSY = "CASE WHEN id % 3 = 0 THEN replace(path, '/', '\\\\') WHEN id % 3 = 1 THEN concat(replace(path, '/', '//'), '/') ELSE path END"


@query("clean_path", with_views(["paths"], f"""
SELECT id, c AS clean, CASE WHEN c = '' OR len(string_split(c, '/')) <= 1 THEN ''
                            ELSE array_to_string(string_split(c, '/')[1:len(string_split(c, '/')) - 1], '/') END AS parent
FROM (SELECT id, array_to_string(list_filter(string_split(replace(coalesce(m, ''), '\\\\', '/'), '/'), lambda x: x <> ''), '/') AS c
      FROM (SELECT id, {_MESSY} AS m FROM paths))
"""))
def q_clean_path(spark, sf_dir):
    p = view(spark, sf_dir, "paths").select("id", F.expr(_MESSY).alias("m"))
    c = pf.clean_path("m")
    return p.select("id", c.alias("clean"), pf.parent_path(c).alias("parent"))


# ---- real folders: suppliers' files below their nation, folders without files, folders that are not there ----

def _made(batches):
    from lakeshore.sources.streams import filesystem
    for pdf in batches:
        for path, is_dir in zip(pdf["path"], pdf["is_dir"]):
            fs, place = filesystem(path)
            fs.create_dir(place if is_dir else place.rsplit("/", 1)[0], recursive=True)
            if not is_dir:
                with fs.open_output_stream(place) as f:
                    f.write(b"x\n1\n")
        yield pdf[["path"]]


def real_tree(spark, sf_dir) -> str:
    """A folder on disk: nations with key % 3 = 0 have a file per supplier
    below a date, those with 1 have only empty folders, the others none."""
    root = scratch_dir(spark, "folders")
    nation, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    files = supplier.join(nation.where("n_nationkey % 3 = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.format_string(f"{root}/%s/2024-01-%02d/s%d.csv", "n_name", F.col("s_suppkey") % 28 + 1, "s_suppkey").alias("path"),
        F.lit(False).alias("is_dir"))
    empty = nation.where("n_nationkey % 3 = 1").select(F.concat(F.lit(root + "/"), "n_name", F.lit("/2030-01-01")).alias("path"),
                                                       F.lit(True).alias("is_dir"))
    files.unionByName(empty).mapInPandas(_made, "path string").write.format("noop").mode("overwrite").save()
    return root


_LISTED = """
SELECT n_name AS folder, n_nationkey AS ord, n_regionkey, n_nationkey,
  CASE WHEN n_nationkey % 3 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'found'
       WHEN n_nationkey % 3 = 1 THEN 'empty' ELSE 'missing' END AS status,
  (SELECT max(printf('2024-01-%02d', s_suppkey % 28 + 1)) FROM supplier WHERE s_nationkey = n_nationkey) AS newest
FROM nation
"""


def _expected(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit(" "), "n_name").alias("folder"),
                                                                 F.col("n_nationkey").alias("ord"))


@query("folder_check_listing", f"SELECT folder, ord, status FROM ({_LISTED})")
def q_folder_check_listing(spark, sf_dir):
    return cat.folder_check_listing(spark, _expected(spark, sf_dir), real_tree(spark, sf_dir))


@query("folder_report_listing", f"""
SELECT count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'empty') AS empty,
  count(*) FILTER (WHERE status = 'found') AS found, count(*) AS total_checked,
  max(CASE WHEN status = 'found' THEN newest END) AS newest_date
FROM ({_LISTED})""")
def q_folder_report_listing(spark, sf_dir):
    root = real_tree(spark, sf_dir)
    tree = folder_tree(spark, root)
    files = tree.where(~F.col("is_dir"))
    checked = cat.folder_check(_expected(spark, sf_dir), files, root, dirs=cat.relative_dirs(tree, root))
    dates = cat.max_date_per_folder(files, root).select(F.substring("folder", len(root) + 2, 1 << 30).alias("folder"), "max_date")
    return cat.folder_report(checked, dates).select("missing", "empty", "found", "total_checked", "newest_date")


@query("check_service_listing", f"""
SELECT lower(r_name) AS service, CASE WHEN count(*) FILTER (WHERE status <> 'found') = 0 THEN 'ok' ELSE 'incomplete' END AS status,
  count(*) AS total_checked, count(*) FILTER (WHERE status = 'found') AS found,
  count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'empty') AS empty
FROM ({_LISTED}) JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY r_name""")
def q_check_service_listing(spark, sf_dir):
    root = real_tree(spark, sf_dir)
    tree = folder_tree(spark, root)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    services = regions.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(True).alias("is_active"))
    sources = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("service_id"), F.col("n_name").alias("name"),
        F.lit(True).alias("is_active"))
    name = regions.where("r_regionkey = 1").first()["r_name"]
    return sv.check_service(services, sources, tree.where(~F.col("is_dir")), root, f" {name} ", cat.relative_dirs(tree, root))
