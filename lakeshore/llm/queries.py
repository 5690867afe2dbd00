"""The registered queries of the pipeline operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import alignment, conversations, exact_dedup, licenses, lm_scoring, mixing, packing, pii, quality, sharding, simhash, topk_search, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents, one row per document."""
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "lang", "n_tokens", "perplexity", "threshold", "kept")


@query("op3_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS level,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place FROM s),
t AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trial FROM l),
w AS (SELECT arg_min(trial, place) AS water FROM t WHERE trial <= level),
x AS (
  SELECT source, source_size,
         CASE WHEN level <= water THEN 2.0 * source_size ELSE water * weight END::DOUBLE AS target FROM t, w),
p AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size DESC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(whole - start, size), 0) + greatest(least(whole - start - source_size, size), 0))::BIGINT AS taken
FROM p""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to target weights, one row per document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license passage in the documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer products of every fiftieth vector with all others."""
    return topk_search.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of four of the five folds."""
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), lambda id_: fold(id_) != 1)
    return scored.withColumnRenamed("id", "doc_id")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the other folds."""
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                      train=fold(F.col("lid")) != 0)
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, one row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that reveal it."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over every document, aligned by bytes, with corpus-wide link counts."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                              tokenizer_path("piece_bpe_32k.model"), digest=True)
    return aligned.select(F.col("id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          F.col("groups").alias("groups_sha256"))


#: CRC-32 of a hexadecimal string's bytes by table, in DuckDB's SQL (it has no such function).
CRC = """
crc_bits(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of the UTF-8 bytes of expression ``text``; needs ``CRC`` and ``crc_table``."""
    pairs = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {pairs}), "
            "lambda c, b: xor(c >> 8, t[1 + xor(c, b) % 256])), 4294967295)")


@query("op11_sharding", f"""
WITH RECURSIVE {CRC},
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:8])::BIGINT % {sharding.SLOTS} AS home,
         row_number() OVER (PARTITION BY doc_id, text) - 1 AS copy
  FROM documents, crc_table),
e AS (SELECT *, (home + copy) % {sharding.SLOTS} AS virtual_slot FROM d),
s AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS turn
      FROM e GROUP BY virtual_slot),
deal(turn, virtual_slot, shard, loads) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1::BIGINT, list_transform(generate_series(1, 24), lambda x: 0::BIGINT)
  UNION ALL
  SELECT s.turn, s.virtual_slot, list_position(loads, list_min(loads)) - 1,
         list_transform(generate_series(1, 24), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.bytes ELSE 0 END)
  FROM deal JOIN s ON s.turn = deal.turn + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, virtual_slot::INTEGER AS virtual_slot,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM e JOIN deal USING (virtual_slot)""")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal size, by a map of virtual slots."""
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                       F.col("slot").alias("virtual_slot"), F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _way(value: str, cost: str, letter: str) -> str:
    """SQL: a way, six digits of cost and the audit, made longer by an edit."""
    return f"lpad(({value}[1:6]::BIGINT + {cost})::VARCHAR, 6, '0') || {value}[7:] || '{letter}'"


def _lattice_sql() -> tuple[str, str]:
    """SQL of the next layer of the lattice: after one row's Keep, Rerole or
    Delete (states n0 to n3 from v0 to v3), then after Inserts (w0 to w3)."""
    extra = "(fault = 3)::BIGINT"

    def keep(s: int, letter: str) -> str:
        return f"CASE WHEN fault NOT IN (1, 2) AND letter = '{letter}' THEN {_way(f'v{s}', extra, 'K')} END"

    def rerole(s: int) -> str:
        return f"CASE WHEN fault NOT IN (1, 2) THEN {_way(f'v{s}', f'2 + {extra}', 'R')} END"
    delete = [_way(f"v{s}", "3", "D") for s in range(4)]
    to_user = ", ".join(f"{keep(s, 'u')}, {rerole(s)}" for s in (0, 1, 3))
    row = (f"{delete[0]} AS n0, least({delete[1]}, {keep(0, 's')}) AS n1, least({delete[2]}, {to_user}) AS n2, "
           f"least({delete[3]}, {keep(2, 'a')}, {rerole(2)}) AS n3")
    user = f"least(n2, {_way('n0', '2', 'I')}, {_way('n1', '2', 'I')})"
    inserts = (f"n0 AS w0, n1 AS w1, least({user}, {_way('n3', '2', 'I')}) AS w2, "
               f"least(n3, {_way(f'({user})', '2', 'I')}) AS w3")
    return row, inserts


_ROW, _INSERTS = _lattice_sql()


@query("op12_conversations", f"""
WITH RECURSIVE {CRC},
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body, role[1:1] AS letter FROM damaged),
facts AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN again > 1 THEN 2 WHEN body[-1:] IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
         lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM facts GROUP BY conv_id),
layers(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, 0::BIGINT, '000000', NULL::VARCHAR, '000002I', '000004II' FROM counts
  UNION ALL
  SELECT conv_id, i, {_INSERTS} FROM (
    SELECT conv_id, i, {_ROW} FROM (
      SELECT f.conv_id, f.i, f.fault, f.letter, w0 AS v0, w1 AS v1, w2 AS v2, w3 AS v3
      FROM layers JOIN facts f ON f.conv_id IS NOT DISTINCT FROM layers.conv_id AND f.i = layers.i + 1))),
ways AS (
  SELECT c.*, least(w0, w3)[1:6]::BIGINT AS cost, least(w0, w3)[7:] AS audit
  FROM counts c JOIN layers l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.n),
walk(conv_id, audit, p, i, state, said) AS (
  SELECT conv_id, audit, 1::BIGINT, 0::BIGINT, 0, []::VARCHAR[] FROM ways
  UNION ALL
  SELECT conv_id, audit, p + 1, i, CASE edit WHEN 'D' THEN state ELSE CASE letter WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END,
         CASE edit WHEN 'D' THEN said ELSE list_append(said, CASE WHEN edit = 'K' THEN role WHEN letter = 'u' THEN 'user' ELSE 'assistant' END
                                                             || ':' || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.conv_id, w.audit, w.p, w.i + (w.audit[w.p:w.p] <> 'I')::BIGINT AS i, w.state, w.said, w.audit[w.p:w.p] AS edit, f.role, f.text,
           CASE WHEN w.audit[w.p:w.p] = 'K' THEN f.letter WHEN w.state = 2 THEN 'a' ELSE 'u' END AS letter
    FROM walk w LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    WHERE w.p <= length(w.audit))),
told AS (SELECT conv_id, said FROM walk WHERE p = length(audit) + 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by the cheapest edits."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")
