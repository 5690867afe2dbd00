"""Query bindings: links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.functions.urls import normalize_url, url_hash
from lakeshore.operators import links as lk
from lakeshore.plans.registry import query
from lakeshore.plans.views import view, with_views

# DuckDB form of the canonical URL for URLs whose query parts need no
# percent-encoding (true of the page URLs); the general form, with
# encoding, is checked against Python's urllib in tests/test_links.py.
_NORM = """
SELECT id, url,
  concat(CASE WHEN scheme <> '' THEN concat(scheme, ':') ELSE '' END,
         CASE WHEN host <> '' THEN concat('//', host, CASE WHEN path <> '' AND NOT starts_with(path, '/') THEN '/' ELSE '' END, path)
              WHEN starts_with(path, '//') THEN concat('//', path)
              WHEN scheme IN ('http', 'https', 'ftp') AND (path = '' OR starts_with(path, '/')) THEN concat('//', path)
              ELSE path END,
         CASE WHEN q <> '' THEN concat('?', q) ELSE '' END,
         CASE WHEN frag <> '' THEN concat('#', frag) ELSE '' END) AS url_normalized
FROM (
  SELECT id, url, lower(regexp_extract(u, '^(([A-Za-z][A-Za-z0-9+.\\-]*):)?', 2)) AS scheme,
    lower(regexp_extract(u, '^(([A-Za-z][A-Za-z0-9+.\\-]*):)?(//([^/?#]*))?', 4)) AS host,
    regexp_replace(lower(regexp_extract(u, '^(([A-Za-z][A-Za-z0-9+.\\-]*):)?(//([^/?#]*))?([^?#]*)', 5)), '(^|/)([^/;]*);$', '\\1\\2') AS path,
    array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*(\\?([^#]*))?', 2), '&'), lambda p: p <> ''),
        lambda p: lower(CASE WHEN strpos(p, '=') > 0 THEN p ELSE concat(p, '=') END))), '&') AS q,
    lower(regexp_extract(u, '^[^#]*(#(.*))?', 2)) AS frag
  FROM (SELECT id, url, trim(url) AS u FROM link_candidates))
"""


@query("normalize_url", with_views(["link_candidates"], "SELECT id, url_normalized FROM norm", norm=_NORM))
def q_normalize_url(spark, sf_dir):
    return view(spark, sf_dir, "link_candidates").select("id", normalize_url("url").alias("url_normalized"))


@query("url_hash", with_views(["link_candidates"], "SELECT id, sha256(url_normalized) AS url_hash FROM norm", norm=_NORM))
def q_url_hash(spark, sf_dir):
    c = view(spark, sf_dir, "link_candidates")
    return c.select("id", url_hash(normalize_url("url")).alias("url_hash"))


@query("links_exist", with_views(["link_candidates", "links_existing"], """
SELECT n.id, n.url, n.url_normalized, sha256(n.url_normalized) AS url_hash,
  EXISTS (SELECT 1 FROM links_existing e WHERE sha256(e.url_normalized) = sha256(n.url_normalized)) AS exists
FROM norm n
""", norm=_NORM))
def q_links_exist(spark, sf_dir):
    cands = view(spark, sf_dir, "link_candidates")
    return lk.links_exist(cands, view(spark, sf_dir, "links_existing").select("url_normalized"))


_STATUS = """
SELECT n.id, n.url, n.url_normalized, sha256(n.url_normalized) AS url_hash,
  CASE WHEN NOT EXISTS (SELECT 1 FROM links_existing e WHERE e.url_normalized = n.url_normalized)
        AND n.id = min(n.id) OVER (PARTITION BY n.url_normalized) THEN 'new' ELSE 'duplicate' END AS status
FROM norm n
"""


@query("new_links", with_views(["link_candidates", "links_existing"], "SELECT * FROM st", norm=_NORM, st=_STATUS))
def q_new_links(spark, sf_dir):
    cands = view(spark, sf_dir, "link_candidates")
    return lk.new_links(cands, view(spark, sf_dir, "links_existing").select("url_normalized"))


@query("link_status_counts", with_views(["link_candidates", "links_existing"],
                                        "SELECT status, count(*) AS n FROM st GROUP BY status", norm=_NORM, st=_STATUS))
def q_link_status_counts(spark, sf_dir):
    cands = view(spark, sf_dir, "link_candidates")
    return lk.link_status_counts(lk.new_links(cands, view(spark, sf_dir, "links_existing").select("url_normalized")))


@query("insert_ignore", with_views(["link_candidates", "links_existing"], """
SELECT id, url, url_normalized, sha256(url_normalized) AS url_hash FROM st WHERE status = 'new'
""", norm=_NORM, st=_STATUS))
def q_insert_ignore(spark, sf_dir):
    cands = view(spark, sf_dir, "link_candidates")
    return lk.insert_new(cands, view(spark, sf_dir, "links_existing").select("url_normalized"))


@query("in_set", with_views(["link_candidates", "links_existing"], """
SELECT id, url FROM link_candidates WHERE lower(url) IN (SELECT url_normalized FROM links_existing)
"""))
def q_in_set(spark, sf_dir):
    cands = view(spark, sf_dir, "link_candidates").withColumn("_l", F.lower("url"))
    known = view(spark, sf_dir, "links_existing").select("url_normalized")
    return lk.in_set(cands, "_l", known).select("id", "url")


@query("in_set_literal", """
SELECT page_id, url FROM pages WHERE page_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)
""")
def q_in_set_literal(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return lk.in_set(pages, "page_id", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
