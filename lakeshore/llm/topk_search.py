"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(``SCALE`` * x).  They are grouped by length:
a bucket is a power range of norms (``GROWTH``), cut into chunks of about
``CHUNK`` rows.  A first round scores each query against the chunk of longest
vectors; its k-th best product is a lower bound t(q) of the query's final
threshold.  A chunk is then visited only by queries with |q| * longest >= t(q).
Inside a chunk, runs of ``RUN`` vectors (longest first) have a local cosine
threshold c = t(q) / (|q| * longest of the run), with t(q) rising as products
are found; a query with c > 1 skips the run.  For a high c the run is pruned by
coordinate: with the query's largest unit coordinate f, a vector can reach
cosine c only if its unit coordinate lies in q_f c -+ sqrt((1 - q_f^2)(1 - c^2)).
For a low c it is pruned by length alone.  What is left is verified by exact
integer products.  Queries are cut into blocks of ``QUERIES``; a task holds one
chunk and one block.

Bounds are floats that lie below the exact products they stand for; products
are compared as exact integers.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part, nor do those of integer components that no long holds (length
2^62 and more); products beyond a long are ranked exactly and returned as the
nearest long; vectors meet only vectors of the same number of
components (the empty vector: product 0); a null id is no query and
comes last in ties; rows that repeat an id are queries and candidates of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import materialise

SCALE = 256
TOP = 5
CHUNK = 4096
QUERIES = 1024
RUN = 1024
GROWTH = 1.1
#: Vectors of this length and more, as integers, take no part; products stay below 2^124.
LONGEST = 2.0 ** 62
#: Relative rounding error of a bound, at most.
ROUNDING = 2.0 ** -50
#: Error of the squares in a coordinate bound, at most.
SQUARES = 1e-14
#: Local cosine threshold from which coordinate pruning is used.
HIGH_COSINE = 0.7


def to_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= LONGEST / scale))
    good = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), good)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` with the rows of ``b``: by
    floats while every sum stays below 2^53, else by Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def _below(bound: np.ndarray) -> np.ndarray:
    """Floats that lie below the exact values which ``bound`` rounds."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(bound), bound, bound - np.abs(bound) * ROUNDING)


def _best(score: np.ndarray, vid: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: score down, then id up (``vid`` has nulls as the largest), then row."""
    return np.lexsort((row, vid, -score if score.dtype != object else np.array([-s for s in score], object)))[:k]


def search_chunk(vectors: np.ndarray, vid: np.ndarray, row: np.ndarray, queries: np.ndarray, qrow: np.ndarray,
                 bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its at most ``k`` best vectors that can
    still reach ``bound`` (-inf: none known), and their products."""
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    qlength = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(len(queries))]
    limit = _below(bound.astype(float))

    def keep(q: int, places: np.ndarray, score: np.ndarray) -> None:
        own = row[places] != qrow[q]
        places, score = np.concatenate((found[q][0], places[own])), np.concatenate((found[q][1], score[own]))
        best = _best(score, vid[places], row[places], k)
        found[q] = places[best], score[best]
        if len(best) == k:
            limit[q] = max(limit[q], float(_below(np.float64(found[q][1][-1]))))

    for start in range(0, len(order), RUN):
        run = order[start:start + RUN]
        longest = length[run[0]] if len(run) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(qlength * longest > 0, limit / (qlength * longest), np.where(limit > 0, np.inf, -np.inf))
        open_ = cosine <= 1 + 1e-9
        high = np.flatnonzero(open_ & (cosine >= HIGH_COSINE))
        low = np.flatnonzero(open_ & (cosine < HIGH_COSINE))
        if len(low):
            score = products(queries[low], vectors[run])
            # The k-th largest product of the run bounds the threshold from below.
            if len(run) > k + 1:
                kth = np.partition(score.astype(float), len(run) - k - 1, axis=1)[:, len(run) - k - 1]
                floor = np.maximum(limit[low], _below(kth))
            else:
                floor = limit[low]
            at, where = np.nonzero(score >= floor[:, None])
            cut = np.searchsorted(at, np.arange(len(low) + 1))
            for i, q in enumerate(low.tolist()):
                pick = where[cut[i]:cut[i + 1]]
                if len(pick):
                    keep(q, run[pick], score[i, pick])
        if len(high):
            unit = vectors[run] / np.maximum(length[run], 1e-300)[:, None]
            by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for q in high.tolist():
                f = int(np.abs(queries[q]).argmax())
                if f not in by:
                    o = np.argsort(unit[:, f], kind="stable")
                    by[f] = o, unit[o, f]
                sorted_, values = by[f]
                c = min(1.0, cosine[q])
                qf = queries[q, f] / qlength[q]
                wide = np.sqrt((max(0.0, 1 - qf * qf) + SQUARES) * (1 - c * c + SQUARES)) + 1e-9
                # Cosines from c to 1 are asked for: the region is widest at c, and its far side ends at 1.
                low_f = qf * c - wide if qf > -c else -1.0
                high_f = qf * c + wide if qf < c else 1.0
                pick = sorted_[np.searchsorted(values, low_f, "left"):np.searchsorted(values, high_f, "right")]
                if len(pick):
                    score = products(queries[q:q + 1], vectors[run[pick]])[0]
                    good = score >= limit[q]
                    if good.any():
                        keep(q, run[pick[good]], score[good])
    return found


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def top_products(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                 k: int = TOP, scale: int = SCALE, chunk: int = CHUNK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows that
    ``is_query`` (a condition on ``id``) names, against all other rows."""
    vec = to_integers(F.col(vector_col), scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("vec is not null")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = materialise(rows.select("id", "vec", F.size("vec").alias("dim"), norm.alias("norm"),
                                   F.monotonically_increasing_id().alias("rid")).filter(
        F.col("norm") < LONGEST), "vectors")
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(GROWTH)))).otherwise(-100_000).cast("long")
    rows = rows.withColumn("bucket", bucket)
    # One row per (dimension, power of GROWTH): a bounded table of metadata.
    parts = rows.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"),
                                              F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("parts"))
    parts = materialise(parts, "buckets")
    chunks = materialise(rows.join(parts, ["dim", "bucket"]).select(
        "dim", "bucket", F.pmod(F.xxhash64("rid"), F.col("parts")).alias("part"), "id", "rid", "vec"), "chunks")
    queries = materialise(rows.filter(is_query).select("dim", "norm", "id", "rid", "vec"), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)))
    head = parts.groupBy("dim").agg(F.max_by("bucket", "longest").alias("bucket"))
    first = queries.join(head, "dim").select("*", F.lit(0).cast("long").alias("part"), F.lit(None).cast("double").alias("bound"))
    kth = _visit(chunks.join(head.withColumnRenamed("bucket", "hb"), "dim").filter("bucket = hb and part = 0").drop("hb"),
                 first, blocks, k)
    kth = materialise(kth, "first-round")
    bound = kth.groupBy("rid").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    rest = queries.join(bound.select("rid", "bound"), "rid", "left")
    rest = rest.join(parts, "dim").filter(F.col("bound").isNull() | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("bound")))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rest = rest.join(head.withColumnRenamed("bucket", "hb"), "dim").filter("not (bucket = hb and part = 0)").select(
        "dim", "bucket", "part", "norm", "id", "rid", "vec", "block", F.col("bound").cast("double").alias("bound"))
    every = kth.unionByName(_visit(chunks, rest, blocks, k))
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vrid"))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit(2 ** 63 - 1)), F.lit(-2 ** 63)).cast("long").alias("score"))


def _visit(chunks: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """Best vectors of each chunk for the queries that visit it."""
    left = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    key = ["dim", "bucket", "part", "block"]

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "rid": [], "vec_id": [], "vrid": [], "score": []}
        if v.num_rows and q.num_rows:
            last = np.iinfo(np.int64).max
            null = v.column("id").is_null().to_numpy()
            vkey = v.column("id").fill_null(last).to_numpy()
            vrid, qrid = v.column("rid").to_numpy(), q.column("rid").to_numpy()
            bound = np.array([-np.inf if b is None else b for b in q.column("bound").to_pylist()])
            got = search_chunk(_matrix(v.column("vec"), v.num_rows), vkey, vrid, _matrix(q.column("vec"), q.num_rows),
                               qrid, bound, k)
            for i, (qid, (places, score)) in enumerate(zip(q.column("id").to_pylist(), got)):
                out["query_id"] += [qid] * len(places)
                out["rid"] += [int(qrid[i])] * len(places)
                out["vec_id"] += [None if null[p] else int(vkey[p]) for p in places]
                out["vrid"] += vrid[places].tolist()
                out["score"] += [int(s) for s in score]
        return pa.table({n: pa.array(c, pa.decimal128(38, 0) if n == "score" else pa.int64()) for n, c in out.items()})

    grouped = left.groupBy(*key).cogroup(queries.select(*key, "id", "rid", "vec", "bound").groupBy(*key))
    return grouped.applyInArrow(run, "query_id bigint, rid bigint, vec_id bigint, vrid bigint, score decimal(38,0)")
