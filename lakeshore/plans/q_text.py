"""Query bindings: text similarity (T1-T6).  Queries = ``benchmark``,
corpus = ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshore.operators import similarity as sim
from lakeshore.plans.registry import query

K = 5
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_TRI = ("list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))")


def _inputs(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return q, d


def _set_sql(items: str, extra_filter: str = "") -> str:
    return f"""
WITH q AS (SELECT item_id AS qid, list_distinct({items}) AS s FROM benchmark),
d AS (SELECT doc_id AS id, list_distinct({items}) AS s FROM documents),
qt AS (SELECT qid, len(s) AS na, unnest(s) AS tok FROM q),
dt AS (SELECT id, len(s) AS nb, unnest(s) AS tok FROM d),
p AS (SELECT qid, id, count(*) AS inter, any_value(na) AS na, any_value(nb) AS nb FROM qt JOIN dt USING (tok) GROUP BY qid, id),
s AS (SELECT qid, id, inter / (na + nb - inter) AS score FROM p),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s {extra_filter})
SELECT qid, id, floor(score * 10000 + 0.5) / 100 AS percentage, rank FROM r WHERE rank <= {K}
"""


@query("tokens", f"""
SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct,
  sha256(array_to_string({_TOK}, ' ')) AS tokens_sha
FROM documents
""")
def q_tokens(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = d.select("doc_id", sim.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"),
                    F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query("jaccard_topk", _set_sql(_TOK))
def q_jaccard_topk(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return sim.jaccard_topk(q, d, K)


@query("trigram_topk", _set_sql(_TRI, "WHERE score > 0.1"))
def q_trigram_topk(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return sim.trigram_topk(q, d, K)


@query("cosine_topk", f"""
WITH qt AS (SELECT qid, tok, count(*) AS tf FROM (SELECT item_id AS qid, unnest({_TOK}) AS tok FROM benchmark) GROUP BY qid, tok),
dt AS (SELECT id, tok, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOK}) AS tok FROM documents) GROUP BY id, tok),
qn AS (SELECT qid, sqrt(sum(tf * tf)) AS qn FROM qt GROUP BY qid),
dn AS (SELECT id, sqrt(sum(tf * tf)) AS dn FROM dt GROUP BY id),
p AS (SELECT qid, id, sum(qt.tf * dt.tf) AS dot FROM qt JOIN dt USING (tok) GROUP BY qid, id),
s AS (SELECT p.qid, p.id, dot / (qn * dn) AS score FROM p JOIN qn USING (qid) JOIN dn USING (id)),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, id, floor(score * 10000 + 0.5) / 100 AS percentage, rank FROM r WHERE rank <= {K}
""")
def q_cosine_topk(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return sim.cosine_topk(q, d, K)


@query("sequence_topk")
def q_sequence_topk(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return sim.sequence_topk(q, d, K)


@query("similarity_report")
def q_similarity_report(spark, sf_dir):
    q, d = _inputs(spark, sf_dir)
    return sim.similarity_report(q, d, K)
