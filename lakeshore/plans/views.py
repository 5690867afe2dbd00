"""Binding views over the driver's tables (FIXTURES.md §3).

Each view is one SQL text that both Spark and DuckDB run unchanged.  Spark
resolves it against the raw tables registered as temporary views; the
oracle inlines it as a CTE because the driver registers only raw tables.
Every view is derived row by row from a driver table, so its size grows
with the scale factor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (sql, views it depends on)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (sql.strip(), deps)


_view("paths", """
SELECT doc_id AS id,
  concat('/data/source/', CASE WHEN doc_id % 7 = 0 THEN '.hid/' ELSE '' END, source, '/',
    CASE WHEN doc_id % 11 = 0 THEN '2024-13-45'
         ELSE concat('2024-0', CAST(1 + doc_id % 9 AS STRING), '-1', CAST(doc_id % 10 AS STRING)) END, '/',
    CASE WHEN doc_id % 5 = 0 THEN 'misc' ELSE concat('20240', CAST(1 + doc_id % 9 AS STRING)) END,
    '/part_', CAST(doc_id AS STRING),
    CASE doc_id % 6 WHEN 0 THEN '.parquet' WHEN 1 THEN '.csv' WHEN 2 THEN '.json'
                    WHEN 3 THEN '.parquet.sended' WHEN 4 THEN '.TXT' ELSE '' END) AS path,
  n_chars AS length
FROM documents
""")

_view("docs_registry", """
SELECT CAST(d.doc_id AS STRING) AS hash_sum, d.source AS name,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE concat('2024', CAST(10 + d.doc_id % 3 AS STRING)) END AS period,
  p.path AS link,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL
       WHEN d.doc_id % 17 = 0 THEN '{"file_size": 5, "row_count": null}'
       ELSE concat('{"file_size": ', CAST(d.n_chars AS STRING), ', "row_count": ', CAST(d.doc_id % 100 AS STRING), '}') END AS validation,
  d.doc_id % 4 <> 0 AS is_active
FROM documents d JOIN paths p ON p.id = d.doc_id
""", ("paths",))

_view("li_trade", """
SELECT concat(l_returnflag, l_linestatus) AS dataset_checksum,
  CAST(l_linenumber - 1 AS BIGINT) AS aggr_level, l_extendedprice AS primary_value,
  CASE WHEN l_partkey % 9 = 0 THEN 'C01' ELSE 'C00' END AS customs_code,
  CAST(l_suppkey % 2 AS STRING) AS mos_code,
  CAST(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS mot_code,
  CASE WHEN l_orderkey % 12 = 0 THEN 4 ELSE 0 END AS partner2_code,
  l_partkey % 4 AS partner_code
FROM lineitem
""")

_view("li_keys", """
SELECT l_orderkey, l_linenumber,
  CASE l_orderkey % 20 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'a/b' WHEN 3 THEN 'a_b'
                       WHEN 4 THEN 'US' WHEN 5 THEN 'US_1' ELSE l_returnflag END AS k1,
  l_linestatus AS k2, l_quantity
FROM lineitem
""")

_view("events_login", """
SELECT event_id AS id, user_id, ts AS login_at, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'invalid_credentials' END AS failure_reason
FROM events
""")

_view("events_mon", """
SELECT event_id AS id, ts AS captured_at, concat('app_', event_type) AS app_name,
  concat('/api/v1/app_', event_type, '/', CAST(user_id AS STRING)) AS path,
  CAST(400 + user_id * 5 AS DOUBLE) AS rss_before_mb,
  CAST(400 + user_id * 5 AS DOUBLE) + (value - 20) AS rss_after_mb,
  value - 20 AS rss_delta_mb
FROM events
""")

_view("link_candidates", """
SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN upper(url) ELSE url END AS url FROM pages
UNION ALL
SELECT page_id + 1000000 AS id, concat(' ', url, ' ') AS url FROM pages WHERE page_id % 4 = 0
""")

_view("links_existing", """
SELECT page_id AS id, lower(url) AS url_normalized FROM pages WHERE page_id % 2 = 0
""")

_view("tasks", """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 50 = 0 THEN '{bad'
       ELSE concat('{"entity":"E', CAST(o_custkey % 5 AS STRING), '","updated_at":"2024-01-1', CAST(o_orderkey % 10 AS STRING),
                   '","period":"2024', CAST(10 + o_orderkey % 3 AS STRING), '","links":[',
                   CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '"http://h/f1.parquet","http://h/f2.parquet"' END, ']}') END AS value
FROM orders
""")

_view("offsets", """
SELECT event_type AS topic, CAST(user_id % 3 AS INT) AS part,
  CASE WHEN user_id % 3 = 2 THEN NULL ELSE min(event_id) + 100 END AS committed,
  max(event_id) AS end_offset
FROM events GROUP BY event_type, user_id % 3
""")

_view("log_lines", """
SELECT event_id AS line_no,
  CASE WHEN event_id % 10 = 0 THEN 'Traceback (most recent call last):'
       ELSE concat(substr(CAST(ts AS STRING), 1, 19), ' | ',
         rpad(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG'
                              WHEN 'signup' THEN 'WARNING' ELSE 'CRITICAL' END, 8, ' '),
         ' | src.core.logger | ', lpad(CAST(user_id AS STRING), 4, ' '), ' | main.py | handler | value=', props) END AS raw
FROM events
""")

# Field tables for the schema operators, derived from lineitem so that they
# grow with the data: every order is one "dataset" whose fields are its line
# numbers.  The source side speaks the parquet dialect, the target side the
# PostgreSQL dialect; some fields exist on one side only.  A field list is a
# map, so a name repeated in the data keeps one (the least) type.
_view("src_fields", """
SELECT schema_id, name, min(type) AS type FROM (
SELECT l_orderkey AS schema_id, concat('f', CAST(l_linenumber AS STRING)) AS name,
  CASE l_partkey % 11 WHEN 0 THEN 'int64' WHEN 1 THEN 'string' WHEN 2 THEN 'double' WHEN 3 THEN 'date32'
       WHEN 4 THEN 'timestamp[us, tz=utc]' WHEN 5 THEN 'boolean' WHEN 6 THEN 'int32' WHEN 7 THEN 'hugeint'
       WHEN 8 THEN '' WHEN 9 THEN 'timestamp[ms]' ELSE 'float' END AS type
FROM lineitem WHERE l_linenumber <> 7) GROUP BY schema_id, name
""")

_view("tgt_fields", """
SELECT schema_id, name, min(type) AS type FROM (
SELECT l_orderkey AS schema_id, concat('f', CAST(l_linenumber AS STRING)) AS name,
  CASE l_suppkey % 12 WHEN 0 THEN 'bigint' WHEN 1 THEN 'character varying(255)' WHEN 2 THEN 'numeric(18,2)'
       WHEN 3 THEN 'timestamp' WHEN 4 THEN 'timestamptz' WHEN 5 THEN 'text' WHEN 6 THEN 'uuid'
       WHEN 7 THEN 'hugeint' WHEN 8 THEN 'integer' WHEN 9 THEN 'double precision' WHEN 10 THEN 'boolean'
       ELSE 'timestamp with time zone' END AS type
FROM lineitem WHERE l_linenumber <> 1) GROUP BY schema_id, name
""")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Views that group a table by nearly every row: the table and the key to deal it by.
DEALT = {"src_fields": ("lineitem", "l_orderkey"), "tgt_fields": ("lineitem", "l_orderkey")}
#: Rows of a task that groups so.
GROUP_ROWS = 1_000_000


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` for a grouping that makes no row fewer.  Such rows
    are few bytes in a shuffle but many in a hash table; partitions merged by
    their bytes would let a task's memory grow with the input."""
    # Without columns a count reads the footers alone.
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // GROUP_ROWS))
    return df.repartition(n, key)


def register_tables(spark: SparkSession, sf_dir: str, names=RAW_TABLES, keys: dict[str, str] | None = None) -> None:
    for name in names:
        df = table(spark, sf_dir, name)
        (_dealt(df, keys[name]) if name in (keys or {}) else df).createOrReplaceTempView(name)


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def _raw_tables_of(sql: str) -> list[str]:
    return [t for t in RAW_TABLES if re.search(rf"\b{t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding view as a Spark DataFrame (raw tables read from sf_dir)."""
    names = _closure([name])
    register_tables(spark, sf_dir, sorted({t for n in names for t in _raw_tables_of(VIEWS[n][0])}),
                    dict(DEALT[n] for n in names if n in DEALT))
    for n in names:
        spark.sql(VIEWS[n][0]).createOrReplaceTempView(n)
    return spark.table(name)


def with_views(names, body: str, **extra: str) -> str:
    """Oracle text: the views, then ``extra`` named subqueries, inlined as
    CTEs ahead of ``body``."""
    ctes = [f"{n} AS (\n{VIEWS[n][0]}\n)" for n in _closure(names)]
    ctes += [f"{n} AS (\n{sql.strip()}\n)" for n, sql in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body.strip()) if ctes else body.strip()


# Registry changes derived from docs_registry: re-registrations (two rounds
# for some keys, the later one wins) and files seen for the first time.
_view("registry_updates", """
SELECT hash_sum, name, period, link, '{"file_size": 1, "row_count": 1}' AS validation, TRUE AS is_active, 1 AS seq
FROM docs_registry WHERE CAST(hash_sum AS BIGINT) % 3 = 0
UNION ALL
SELECT hash_sum, name, period, link, '{"file_size": 2, "row_count": 2}' AS validation, FALSE AS is_active, 2 AS seq
FROM docs_registry WHERE CAST(hash_sum AS BIGINT) % 6 = 0
UNION ALL
SELECT concat('new', hash_sum) AS hash_sum, name, period, link, validation, TRUE AS is_active, 1 AS seq
FROM docs_registry WHERE CAST(hash_sum AS BIGINT) % 5 = 0
""", ("docs_registry",))

# Partial updates: a null means "field not supplied".
_view("registry_changes", """
SELECT hash_sum,
  CASE WHEN CAST(hash_sum AS BIGINT) % 2 = 0 THEN concat(name, '_v2') END AS name,
  CASE WHEN CAST(hash_sum AS BIGINT) % 3 = 0 THEN '209901' END AS period
FROM docs_registry WHERE CAST(hash_sum AS BIGINT) % 4 = 1
""", ("docs_registry",))

# The files that are still on disk: every ninth file has gone.
_view("catalog_now", """
SELECT id, path, length FROM paths WHERE id % 9 <> 0
""", ("paths",))

# Date-like texts for the date parser, derived from event times.
_view("date_texts", """
SELECT event_id AS id,
  CASE event_id % 6 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10)
                    WHEN 1 THEN replace(CAST(ts AS STRING), ' ', 'T')
                    WHEN 2 THEN CAST(ts AS STRING)
                    WHEN 3 THEN '2024'
                    WHEN 4 THEN concat('2024-02-', lpad(CAST(user_id % 32 AS STRING), 2, '0'))
                    ELSE props END AS text
FROM events
""")

# Folders a caller asks about: every source (with a blank in front), some
# that do not exist, and blank entries.
_view("expected_folders", """
SELECT doc_id AS ord,
  CASE WHEN doc_id % 50 = 0 THEN concat(source, '_old') WHEN doc_id % 23 = 0 THEN '  ' ELSE concat(' ', source) END AS folder
FROM documents
""")

# A catalog where some '.sended' files also exist without the suffix.
_view("paths_sended", """
SELECT id, path FROM paths
UNION ALL
SELECT id + 1000000 AS id, regexp_replace(path, '\\.sended$', '') AS path FROM paths WHERE id % 12 = 3 AND id % 24 <> 3
""", ("paths",))

# Secret-bearing texts: document text with key=value, Bearer and query
# secrets spliced in (some safe values among them).
_view("secret_texts", """
SELECT doc_id AS id,
  concat(substr(text, 1, 200),
    CASE doc_id % 8 WHEN 0 THEN concat(' api_key=', md5(text), ' ')
                    WHEN 1 THEN concat(' Authorization: Bearer ', md5(text), md5(source), ' ')
                    WHEN 2 THEN concat(' see https://x.example/cb?token=', md5(text), '&a=1 ')
                    WHEN 3 THEN concat(' password: "', md5(source), '" ')
                    WHEN 4 THEN ' token=12345678901234567890 '
                    WHEN 5 THEN ' secret=0f8fad5b-d9cb-469f-a165-70867728950e '
                    WHEN 6 THEN concat(' client_secret = ', substr(md5(text), 1, 6), ' ')
                    ELSE ' auth=short ' END,
    substr(text, 201)) AS text
FROM documents
""")

# Download task messages in both layouts, derived from orders.
_view("download_msgs", """
SELECT o_orderkey AS id,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('{"task_id":"t', CAST(o_orderkey AS STRING), '","urls":["http://h/a.parquet","http://h/b.parquet"],',
                       '"dest_path":"/E', CAST(o_custkey % 5 AS STRING), '/2024-01-1', CAST(o_orderkey % 10 AS STRING), '/',
                       '","entity":"X","period":"202401","split_columns":["k1","",5,"k2"]}')
    WHEN 1 THEN concat('{"url":"http://h/one.csv","relative_path":"E', CAST(o_custkey % 5 AS STRING), '/2024-02-0',
                       CAST(o_orderkey % 10 AS STRING), '","entity":"ignored","period":"2024', CAST(10 + o_orderkey % 3 AS STRING),
                       '","split_columns":"k1"}')
    WHEN 2 THEN concat('{"url":["http://h/1.json","http://h/2.json","http://h/3.json"],"relative_path":"E',
                       CAST(o_custkey % 5 AS STRING), '","updated_at":"2024-03-01","period":"202403","split_column":"k2"}')
    WHEN 3 THEN concat('{"task_id":"t', CAST(o_orderkey AS STRING), '","urls":[],"dest_path":"E1/2024-01-01/202401"}')
    WHEN 4 THEN '{not json'
    ELSE concat('{"urls":["http://h/x.parquet"],"dest_path":"","entity":"E', CAST(o_custkey % 5 AS STRING),
                '","updated_at":"2024-04-0', CAST(o_orderkey % 9 + 1 AS STRING), '","period":"202404"}') END AS value
FROM orders
""")

# The trade view with a folder number (three folders of one entity).
_view("li_trade_parts", """
SELECT concat(l_returnflag, l_linestatus) AS dataset_checksum,
  CAST(l_linenumber - 1 AS BIGINT) AS aggr_level, l_extendedprice AS primary_value,
  CASE WHEN l_partkey % 9 = 0 THEN 'C01' ELSE 'C00' END AS customs_code,
  CAST(l_suppkey % 2 AS STRING) AS mos_code,
  CAST(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS mot_code,
  CASE WHEN l_orderkey % 12 = 0 THEN 4 ELSE 0 END AS partner2_code,
  l_partkey % 4 AS partner_code, CAST(l_orderkey % 3 AS INT) AS part_no
FROM lineitem
""")
