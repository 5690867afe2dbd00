"""H6/H7: canonical URLs by examples, and the new/duplicate rules."""

import hashlib

from lakeshore.functions.urls import normalize_url, url_hash
from lakeshore.operators import links as lk

# URL as given -> canonical form.
EXAMPLES = {
    "HTTP://User@Ex.COM:8080/A/B?b=2&A=1&a=3#Frag": "http://user@ex.com:8080/a/b?a=1&a=3&b=2#frag",
    " http://x.com/p?q=a+b&q=%41&z= ": "http://x.com/p?q=a+b&q=a&z=",
    "http://x.com/p?k": "http://x.com/p?k=",
    "http://x.com/p?%zz=1": "http://x.com/p?%25zz=1",
    "http://x.com/p?a=*~&b=c d": "http://x.com/p?a=%2A~&b=c+d",
    "ftp://E.com/X;": "ftp://e.com/x",
    "ftp://E.com/X;Y": "ftp://e.com/x;y",
    "www.example.com/Path": "www.example.com/path",
    "http://x.com?#": "http://x.com",
    "http://x.com/a;b/c;": "http://x.com/a;b/c",
    "mailto:A@B.com": "mailto:a@b.com",
    "http:///x": "http:///x",
    "HTTP://X.COM": "http://x.com",
    "http://x.com/p?B=1&b=2&B=0": "http://x.com/p?b=1&b=0&b=2",
    "http://x.com/p?a=1&&b": "http://x.com/p?a=1&b=",
    "//host/p": "//host/p",
    "http://x.com/p?q=%E2%82%AC": "http://x.com/p?q=%E2%82%AC",
    "localhost:8080/x": "localhost:8080/x",
    "http://x.com/p?a=b=c": "http://x.com/p?a=b%3Dc",
    "http://x.com/ü?ä=ö": "http://x.com/ü?%C3%A4=%C3%B6",
    "https://Example.com/Path/?Z=1&y=2#Top": "https://example.com/path/?y=2&z=1#top",
}
EDGE = list(EXAMPLES)


def test_normalize_edge_urls(spark):
    df = spark.createDataFrame([(u,) for u in EDGE], "url string")
    got = {r["url"]: r["n"] for r in df.select("url", normalize_url("url").alias("n")).collect()}
    assert got == EXAMPLES


def test_hash_is_sha256_of_the_canonical_form(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = pages.select(normalize_url("url").alias("n"), url_hash(normalize_url("url")).alias("h")).collect()
    assert rows and all(r["h"] == hashlib.sha256(r["n"].encode()).hexdigest() for r in rows)


def test_normalize_idempotent(spark):
    df = spark.createDataFrame([(u,) for u in EDGE], "url string")
    once = df.select(normalize_url("url").alias("u"))
    twice = once.select(normalize_url("u").alias("u2"), "u")
    assert all(r["u"] == r["u2"] for r in twice.collect())


def test_new_plus_duplicate_is_input(spark):
    c = spark.createDataFrame([(1, "http://a.com/X"), (2, "http://A.com/x"), (3, "http://b.com"), (4, "http://c.com")],
                              "id long, url string")
    links = spark.createDataFrame([("http://c.com",)], "url_normalized string")
    st = {r["id"]: r["status"] for r in lk.new_links(c, links).collect()}
    assert st == {1: "new", 2: "duplicate", 3: "new", 4: "duplicate"}
    compat = {r["id"]: r["status"] for r in lk.new_links(c, links, compat=True).collect()}
    assert compat[2] == "new"


def test_hot_url_is_not_one_tasks_work(spark):
    hot = [(i, "http://hot.com/x" if i % 3 == 0 else f"http://h{i}.com") for i in range(3000)]
    c = spark.createDataFrame(hot, "id long, url string")
    links = spark.createDataFrame([("http://h1.com",), ("http://hot.com/x",)], "url_normalized string")
    exists = lk.links_exist(c, links)
    assert {r["id"] for r in exists.where("exists").collect()} == {1, *range(0, 3000, 3)}
    status = {r["id"]: r["status"] for r in lk.new_links(c, links).collect()}
    assert [i for i, s in status.items() if s == "new"] and all((status[i] == "duplicate") == (i % 3 == 0 or i == 1) for i in status)
    for df in (exists, lk.new_links(c, links)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_salt" in plan
    groups = spark.createDataFrame([(1, "open"), (2, "done")], "id long, status string")
    files = spark.createDataFrame([(1, "u", 1), (1, "u", 2), (1, None, 3), (1, None, 4), (2, "u", 9), (3, "x", 1)],
                                  "group_id long, url string, seq long")
    from lakeshore.operators.services import group_files
    got = sorted((r["group_id"], r["seq"], r["group_status"], r["is_duplicate"]) for r in group_files(groups, files).collect())
    assert got == [(1, 1, "open", False), (1, 2, "open", True), (1, 3, "open", False), (1, 4, "open", True), (2, 9, "done", False)]
