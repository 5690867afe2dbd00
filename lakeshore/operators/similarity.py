"""Text duplicate check: word Jaccard, word-frequency cosine, trigram
similarity and sequence ratio, top-k per query, many queries at once.

Set and vector similarities are token joins: each side is exploded to
(record, token) rows, joined on the token, and the overlap per pair is an
aggregate.  Pairs that share no token never exist.  The top k by sets take a
table of the queries' tokens to the documents instead, after the table's size
has been counted and found under a bound; otherwise the join shuffles both
sides on the token and AQE splits skewed (very common) tokens over several
tasks.

The sequence ratio has no token form.  It is computed exactly with
``difflib`` inside tasks, where groups of documents meet groups of queries,
but only for pairs that can still enter a query's top k: the best
Jaccard/trigram pairs fix a lower bound per query, and upper bounds of the
ratio (by length, then by the passages that can match) rule out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.operators.common import spread_for_cpu
from lakeshore.session import checkpoint_root

# Token pattern (letters, digits, underscore; Unicode) and the
# word pattern for trigrams (letters and digits).
TOKEN_RE = r"[\p{L}\p{N}_]+"
WORD_RE = r"[\p{L}\p{N}]+"
TRIGRAM_MIN = 0.1


def tokens(text) -> Column:
    """Lower-case word tokens (maximal runs of letters, digits, _)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


def trigrams(text) -> Column:
    """Distinct 3-grams of each word padded with two blanks before and one
    after.  The padded words are joined with a separator and every
    overlapping 3-character window that does not cross a separator is taken
    by one look-ahead regex: built-in expressions only, no per-word lambda."""
    c = F.col(text) if isinstance(text, str) else text
    # A word's trigrams do not depend on how often it occurs: distinct words first.
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD_RE), 0))
    padded = F.concat(F.lit("  "), F.array_join(words, " \u0001  "), F.lit(" "))
    grams = F.regexp_extract_all(padded, F.lit("(?=([^\u0001]{3}))"), 1)
    return F.array_distinct(F.when(F.size(words) > 0, grams).otherwise(F.array().cast("array<string>")))


def percentage(score: Column) -> Column:
    """Score in 0..1 as a percentage with two decimals, half away from zero."""
    return F.floor(score * 10000 + 0.5) / 100


def top_k(scores: DataFrame, k: int | None, qcol: str = "qid", dcol: str = "id") -> DataFrame:
    """Rank per query by score desc, id asc; keep k (Spark plans a
    WindowGroupLimit, so each task keeps at most k rows per query)."""
    w = Window.partitionBy(qcol).orderBy(F.col("score").desc(), F.col(dcol).asc())
    ranked = scores.withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked


def _explode(arr: Column) -> Column:
    # ``explode_outer`` + a null filter instead of ``explode``: for an inner
    # explode Spark infers a size(array) > 0 filter below the projection,
    # which evaluates the (costly) array expression a second time.
    return F.explode_outer(arr)


def _by_document(df: DataFrame, key: str) -> DataFrame:
    """The corpus dealt out by document before its tokens are exploded: what
    is then grouped by (document, query) or (document, token) stays in its
    task, so pairs never cross the network.  The partition count is the
    session's (an explicit one: AQE would merge few bytes of much work)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), key)


def _set_rows(df: DataFrame, key: str, items: Column, corpus: bool = False) -> DataFrame:
    s = (_by_document(df, key) if corpus else spread_for_cpu(df)).select(F.col(key).alias("_key"), F.array_distinct(items).alias("_set"))
    # A non-nullable size: with a nullable one, Catalyst infers
    # isnotnull(size(<set expression>)) from the join condition and pushes it
    # to the scan, evaluating the whole set expression a second time there.
    return (s.select("_key", F.coalesce(F.size("_set"), F.lit(0)).alias("_n"), _explode(F.col("_set")).alias("_tok"))
            .where(F.col("_tok").isNotNull()))


def set_similarity(queries: DataFrame, corpus: DataFrame, q_items: Column, d_items: Column,
                   qid: str = "qid", did: str = "id", min_score: float | None = None) -> DataFrame:
    """|A n B| / (|A| + |B| - |A n B|) for every pair sharing an item.

    With ``min_score`` m only pairs that can exceed it are formed: since
    |A n B| <= min(|A|, |B|), a score above m needs
    (1 + m) min(|A|, |B|) > m (|A| + |B|).  The test is part of the join
    condition, so impossible pairs are never emitted (exact, no cap)."""
    q = _set_rows(queries, qid, q_items).select(F.col("_key").alias("qid"), F.col("_n").alias("na"),
                                                F.col("_tok").alias("_qtok"))
    d = _set_rows(corpus, did, d_items, corpus=True).select(F.col("_key").alias("id"), F.col("_n").alias("nb"), "_tok")
    cond = F.col("_tok") == F.col("_qtok")
    if min_score is not None:
        m = float(min_score)
        cond = cond & ((1 + m) * F.least("na", "nb") > m * (F.col("na") + F.col("nb")))
    # na / nb depend on qid / id alone: grouping by them too leaves a single
    # counter as the aggregation buffer.
    pairs = d.join(q, cond).groupBy("qid", "id", "na", "nb").agg(F.count(F.lit(1)).alias("inter"))
    return pairs.select("qid", "id", (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("score"))


#: Cells of the table of the queries' items that every worker holds, at most.
TABLE_CELLS = 1 << 26


@dataclass
class QueryTable:
    """The queries' items as a table, items x queries, 1 where a query has the item."""
    qids: pa.Array
    sizes: np.ndarray
    items: pa.Array
    has: np.ndarray

    @classmethod
    def of(cls, q: pa.Table) -> QueryTable:
        """From ``_key`` and ``_set``, one row a query."""
        sets = pa.concat_arrays(q.column("_set").chunks) if q.num_rows else pa.array([], q.schema.field("_set").type)
        sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = sets.flatten()
        items = flat.unique().drop_null()
        # A number of the type holds the overlap with any document.
        has = np.zeros((len(items), len(sizes)), np.min_scalar_type(int(sizes.max(initial=0))))
        at = pc.index_in(flat, value_set=items)
        have = at.is_valid().to_numpy(zero_copy_only=False)
        has[at.drop_null().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)[have]] = 1
        return cls(pa.concat_arrays(q.column("_key").chunks) if q.num_rows else pa.array([], q.schema.field("_key").type),
                   sizes, items, has)

    def scores(self, sets: pa.Array) -> Iterator[np.ndarray]:
        """Per document its similarity to every query."""
        n = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(sets.flatten(), value_set=self.items)
        known = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))
        at, ends = at.drop_null().to_numpy(), np.cumsum(n)
        for size, start, end in zip(n.tolist(), known[ends - n].tolist(), known[ends].tolist()):
            both = self.has.take(at[start:end], axis=0).sum(axis=0, dtype=self.has.dtype).astype(np.int64)
            yield both / np.maximum(self.sizes + size - both, 1)


def _best_of(batches: Iterator[pa.RecordBatch], table: QueryTable, k: int, min_score: float) -> Iterator[pa.RecordBatch]:
    """The ``k`` documents (``id``, ``items``) of each query with the highest
    scores above ``min_score``, ties to smaller ids."""
    best, least, n = None, np.zeros(len(table.sizes)), len(table.sizes)
    for batch in batches if n else ():
        ids = batch.column(0)
        for start in range(0, batch.num_rows, 256):
            part = np.array(list(table.scores(batch.column(1).slice(start, 256)))).reshape(-1, n)
            doc, q = np.nonzero((part > min_score) & (part >= least))
            if not len(doc):
                continue
            found = pa.table({"q": q, "id": ids.slice(start, 256).take(pa.array(doc)), "score": part[doc, q]})
            best = found if best is None else pa.concat_tables([best, found])
            best = best.take(pc.sort_indices(best, [("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
            q = best["q"].to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = q[place == k - 1]
            least[full] = best["score"].to_numpy()[place == k - 1]
            best = best.filter(pa.array(place < k))
    if best is not None:
        out = pa.table({"qid": table.qids.take(pa.array(best["q"].to_numpy())), "id": best["id"], "score": best["score"]})
        yield from out.combine_chunks().to_batches()


def set_topk(queries: DataFrame, corpus: DataFrame, q_items: Column, d_items: Column, k: int | None,
             qid: str = "qid", did: str = "id", min_score: float | None = None) -> DataFrame:
    """The top k of ``set_similarity``.

    Where the queries make a small table, every task adds up the table's rows
    of a document's items (all its overlaps at once) and keeps k documents per
    query; no pair becomes a row.  Many queries, or ids that occur twice, go
    by ``set_similarity``, with the same results."""
    spark = corpus.sparkSession
    q = spread_for_cpu(queries).select(F.col(qid).alias("_key"), F.array_distinct(q_items).alias("_set"))
    n, ids, items = q.agg(F.count(F.lit(1)), F.count_distinct("_key"), F.sum(F.size("_set"))).first()
    repeated = n != ids or not corpus.groupBy(did).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    if k is None or repeated or n * (items or 0) > TABLE_CELLS:
        s = set_similarity(queries, corpus, q_items, d_items, qid, did, min_score=min_score)
        return top_k(s if min_score is None else s.where(F.col("score") > min_score), k)
    table = spark.sparkContext.broadcast(QueryTable.of(q.toArrow()))
    d = _by_document(corpus, did).select(F.col(did).alias("id"), F.array_distinct(d_items).alias("_set"))
    kinds = q.schema["_key"].dataType.simpleString(), d.schema["id"].dataType.simpleString()
    best = d.mapInArrow(lambda batches: _best_of(batches, table.value, k, min_score or 0.0), "qid {}, id {}, score double".format(*kinds))
    return top_k(best, k)


def jaccard_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", qtext: str = "text",
                 did: str = "id", dtext: str = "text") -> DataFrame:
    """Word-set Jaccard; an empty query has no result; positive scores."""
    s = set_topk(queries, corpus, tokens(qtext), tokens(dtext), k, qid, did)
    return s.select("qid", "id", percentage(F.col("score")).alias("percentage"), "rank")


def trigram_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", qtext: str = "text",
                 did: str = "id", dtext: str = "text", min_score: float = TRIGRAM_MIN) -> DataFrame:
    """T4: trigram-set similarity above ``min_score``."""
    s = set_topk(queries, corpus, trigrams(qtext), trigrams(dtext), k, qid, did, min_score=min_score)
    return s.select(
        "qid", "id", percentage(F.col("score")).alias("percentage"), "rank")


def _tf(df: DataFrame, key: str, text: str, alias: str, corpus: bool = False) -> DataFrame:
    t = ((_by_document(df, key) if corpus else spread_for_cpu(df)).select(F.col(key).alias(alias), _explode(tokens(text)).alias("_tok"))
         .where(F.col("_tok").isNotNull()))
    return t.groupBy(alias, "_tok").agg(F.count(F.lit(1)).alias("tf"))


def cosine_scores(queries: DataFrame, corpus: DataFrame, qid: str = "qid", qtext: str = "text",
                  did: str = "id", dtext: str = "text") -> DataFrame:
    qtf = _tf(queries, qid, qtext, "qid")
    dtf = _tf(corpus, did, dtext, "id", corpus=True)
    qn = qtf.groupBy("qid").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qn"))
    dn = dtf.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    dots = (dtf.withColumnRenamed("tf", "dtf").join(qtf.withColumnRenamed("tf", "qtf"), "_tok")
            .groupBy("qid", "id").agg(F.sum(F.col("qtf") * F.col("dtf")).alias("dot")))
    return (dots.join(qn, "qid").join(dn, "id")
            .select("qid", "id", (F.col("dot") / (F.col("qn") * F.col("dn"))).alias("score")))


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", qtext: str = "text",
                did: str = "id", dtext: str = "text") -> DataFrame:
    """Cosine of word-frequency vectors; positive scores."""
    s = cosine_scores(queries, corpus, qid, qtext, did, dtext)
    return top_k(s, k).select("qid", "id", percentage(F.col("score")).alias("percentage"), "rank")


# ---- sequence ratio -----------------------------------------------------

def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs are few bytes but much CPU: AQE would coalesce them into one
    task.  An explicit partition count keeps the exact comparisons spread
    over every core of the cluster."""
    n = max(1, pairs.sparkSession.sparkContext.defaultParallelism * 4)
    return pairs.repartition(n, "qid", "id")


def _ratios(batches):
    from difflib import SequenceMatcher
    for pdf in batches:
        score = [SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(pdf["qt"], pdf["dt"])]
        yield pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "score": score})


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Exact ratio for (qid, id, qt, dt) pairs, after the spreading
    exchange.  ``mapInPandas`` is a plan node of its own: unlike a scalar
    UDF projection, the optimizer cannot move it below the repartition
    (where AQE would merge the small-but-costly pairs into one task)."""
    return _spread(pairs.select("qid", "id", "qt", "dt")).mapInPandas(_ratios, "qid long, id long, score double")


def _can_match(a: str, b: str, b2j: dict[str, list[int]]) -> int:
    """At most this many characters of ``a`` lie in matching blocks.

    ``SequenceMatcher`` starts a block only at a character of ``b2j`` (in texts
    of 200 characters or more the frequent ones are left out) and extends it
    both ways; only the texts' common beginning is matched without such a
    start.  So every matched character lies in a common passage around a start,
    or in the beginning."""
    n, m = len(a), len(b)
    end = 0
    while end < n and end < m and a[end] == b[end]:
        end += 1
    covered = end                   # characters before ``end`` that may match
    for i, c in enumerate(a):
        left = right = -1
        for j in b2j.get(c, ()):
            x = 0
            while x < i and x < j and a[i - x - 1] == b[j - x - 1]:
                x += 1
            left, x = max(left, x), 1
            while i + x < n and j + x < m and a[i + x] == b[j + x]:
                x += 1
            right = max(right, x)
        if right > 0 and i + right > end:
            covered += i + right - max(end, i - left)
            end = i + right
    return covered


def _best_ratios(k: int):
    """Per group of documents the k best positive ratios of each query, no
    pair that is sure to be worse than ``r`` or than k others of the group."""
    import heapq
    from difflib import SequenceMatcher

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        qids, texts, la = list(queries["qid"]), list(queries["qt"]), queries["la"].to_numpy(np.int64)
        least = queries["r"].to_numpy(np.float64).copy()
        best: list[list[tuple[float, int]]] = [[] for _ in qids]
        # Short texts first: they have the high ratios, and those rule out the long ones by length.
        for id_, text in sorted(zip(docs["id"], docs["dt"]), key=lambda x: (len(x[1]), x[0])) if qids else ():
            lb = len(text)
            total = la + lb
            may = np.where(total > 0, 2.0 * np.minimum(la, lb) / np.maximum(total, 1), 1.0)
            near = np.flatnonzero(may >= least)
            if not len(near):
                continue
            match = SequenceMatcher(None, "", text)
            for at in near:
                a, size = texts[at], int(total[at])
                if size:
                    match.set_seq1(a)
                    if match.bpopular:
                        most = 2.0 * _can_match(a, text, match.b2j) / size
                    else:
                        most = match.quick_ratio()
                    if most < least[at] or most <= 0:
                        continue
                    score = match.ratio()
                else:
                    score = 1.0     # two empty texts
                if score <= 0 or score < least[at]:
                    continue
                heap = best[at]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -id_))
                else:
                    heapq.heappushpop(heap, (score, -id_))
                if len(heap) == k:
                    least[at] = max(least[at], heap[0][0])
        rows = [(q, -i, s) for q, heap in zip(qids, best) for s, i in heap]
        return pd.DataFrame(rows, columns=["qid", "id", "score"]).astype({"qid": "int64", "id": "int64", "score": "float64"})
    return run


#: Queries that meet a group of documents together, and characters of such a group.
GROUP_QUERIES = 256
GROUP_CHARS = 4_000_000


def sequence_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", qtext: str = "text",
                  did: str = "id", dtext: str = "text", seed_lists: list[DataFrame] | None = None) -> DataFrame:
    """T5: exact top k by ``SequenceMatcher(None, query, text).ratio()``.

    1. Seeds: the best Jaccard and trigram pairs (exact ratio computed).
       The k-th best seed ratio r_q is a lower bound of the final k-th.
    2. Documents and queries are dealt into groups of bounded size, every
       document meets every query in one group.  Per document the matcher is
       prepared once; a pair is compared only if upper bounds of its ratio (by
       length, then by the passages that can match) reach r_q and the k-th
       best of the group so far.
    3. The best of all groups are ranked.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("qt"), F.length(qtext).alias("la")).where("qt is not null")
    d = corpus.select(F.col(did).alias("id"), F.col(dtext).alias("dt")).where("dt is not null")
    if seed_lists is None:
        seed_lists = [jaccard_topk(queries, corpus, k, qid, qtext, did, dtext),
                      trigram_topk(queries, corpus, k, qid, qtext, did, dtext)]
    seeds = reduce(DataFrame.unionByName, [x.select("qid", "id") for x in seed_lists]).distinct()
    # At most 2k rows per query.
    seeded = score_pairs(seeds.join(q, "qid").join(d, "id"))
    kth = (top_k(seeded, k).groupBy("qid")
           .agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("r")))
    bound = (q.join(kth, "qid", "left")
             .select("qid", "qt", "la", F.when(F.col("m") >= k, F.col("r")).otherwise(F.lit(0.0)).alias("r")))
    chars = d.agg(F.sum(F.length("dt"))).first()[0] or 0
    parts = -(-q.count() // GROUP_QUERIES) or 1
    # Many groups a core: keys are dealt by hash, so some tasks get several of them.
    deals = max(spark.sparkContext.defaultParallelism * 16, -(-chars // GROUP_CHARS))
    some = bound.select("*", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    docs = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                    F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int").alias("deal"))
    # An explicit partition count: few bytes of much work, which AQE would merge.
    n = min(parts * deals, max(deals, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    some, docs = (x.repartition(n, "part", "deal") for x in (some, docs))
    scored = some.groupBy("part", "deal").cogroup(docs.groupBy("part", "deal")).applyInPandas(
        _best_ratios(k), "qid long, id long, score double")
    return top_k(scored, k).select("qid", "id", percentage(F.col("score")).alias("percentage"), "rank")


def similarity_report(queries: DataFrame, corpus: DataFrame, k: int = 5, **cols) -> DataFrame:
    """The four lists together, one ``method`` column.  The Jaccard and
    trigram lists (k rows per query) are cut from their lineage once and
    serve both as results and as the sequence seeds."""
    checkpoint_root(queries.sparkSession)
    jac = jaccard_topk(queries, corpus, k, **cols).checkpoint()
    tri = trigram_topk(queries, corpus, k, **cols).checkpoint()
    parts = [
        jac.withColumn("method", F.lit("jaccard")),
        cosine_topk(queries, corpus, k, **cols).withColumn("method", F.lit("cosine")),
        tri.withColumn("method", F.lit("pg_trgm")),
        sequence_topk(queries, corpus, k, seed_lists=[jac, tri], **cols).withColumn("method", F.lit("sequence")),
    ]
    return reduce(DataFrame.unionByName, parts)
