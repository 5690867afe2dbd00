"""T1-T5 against plain-Python definitions (brute force over all pairs)."""

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.operators import similarity as sim

K = 5


def toks(s):
    return re.findall(r"[\w]+", s.lower())


def pct(x):
    return math.floor(x * 10000 + 0.5) / 100


def trigram_set(s):
    out = set()
    for w in re.findall(r"[^\W_]+", s.lower()):
        p = "  " + w + " "
        out.update(p[i:i + 3] for i in range(len(w) + 1))
    return out


def brute(queries, docs, score, keep=lambda s: s > 0):
    res = []
    for qid, qt in queries:
        sc = sorted(((score(qt, dt), did) for did, dt in docs), key=lambda x: (-x[0], x[1]))
        sc = [x for x in sc if keep(x[0])][:K]
        res += [(qid, did, pct(s), i + 1) for i, (s, did) in enumerate(sc)]
    return sorted(res)


def jac(a, b):
    A, B = set(toks(a)), set(toks(b))
    return len(A & B) / len(A | B) if A and B else 0.0


@cache
def counts(text):
    return Counter(toks(text))


def cos(a, b):
    """Of the count vectors over the union of both texts' words."""
    first, second = counts(a), counts(b)
    words = list(first.keys() | second.keys())
    x, y = (np.array([v[w] for w in words], float) for v in (first, second))
    length = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / length) if length else 0.0


def tri(a, b):
    A, B = trigram_set(a), trigram_set(b)
    i = len(A & B)
    return i / (len(A) + len(B) - i) if A and B else 0.0


@pytest.fixture(scope="module")
def data(spark, sf):
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return q, d, [tuple(r) for r in q.collect()], [tuple(r) for r in d.collect()]


def test_tokens_match_python(spark, data):
    _, d, _, docs = data
    got = {r[0]: r[1] for r in d.select("id", sim.tokens("text")).collect()}
    for did, text in docs:
        assert got[did] == toks(text)


def test_jaccard(data):
    q, d, Q, D = data
    assert sorted(tuple(r) for r in sim.jaccard_topk(q, d, K).collect()) == brute(Q, D, jac)


def test_cosine(data):
    q, d, Q, D = data
    assert sorted(tuple(r) for r in sim.cosine_topk(q, d, K).collect()) == brute(Q, D, cos)


def test_trigram(data):
    q, d, Q, D = data
    assert sorted(tuple(r) for r in sim.trigram_topk(q, d, K).collect()) == brute(Q, D, tri, lambda s: s > 0.1)


def test_sequence_small_fixture(spark, data):
    q, d, Q, D = data
    q10 = q.where(F.col("qid") < 8)
    d60 = d.where(F.col("id") < 60)
    exp = brute([x for x in Q if x[0] < 8], [x for x in D if x[0] < 60],
                lambda a, b: SequenceMatcher(None, a, b).ratio())
    assert sorted(tuple(r) for r in sim.sequence_topk(q10, d60, K).collect()) == exp


def test_scores_in_range_and_symmetric(spark):
    a = spark.createDataFrame([(1, "the cat sat"), (2, "a dog ran"), (3, "")], "qid long, text string")
    b = a.select(F.col("qid").alias("id"), "text")
    s = {(r.qid, r.id): r.score for r in sim.set_similarity(a, b, sim.tokens("text"), sim.tokens("text")).collect()}
    assert all(0 <= v <= 1 for v in s.values())
    assert all(s[(x, y)] == s[(y, x)] for (x, y) in s)
    assert (3, 3) not in s   # an empty text has no result


def test_edge_texts(spark):
    texts = ["", "a", "!!!", "ёлка İstanbul", "x" * 250, "same text", "same text", "disjoint words"]
    df = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    d = df.select(F.col("qid").alias("id"), "text")
    got = sorted(tuple(r) for r in sim.jaccard_topk(df, d, K).collect())
    assert got == brute(list(enumerate(texts)), list(enumerate(texts)), jac)


def test_sequence_bound_holds_and_documents_are_prepared_once(spark, data):
    """No ratio is above the bound; long texts, prefixes and repeats included."""
    _, _, Q, D = data
    extra = [(9001, Q[0][1]), (9002, Q[0][1] * 9), (9003, Q[1][1][:40] + "e" * 500), (9004, ""), (9005, "ab" * 300 + Q[2][1])]
    docs = D[:25] + extra
    for _, b in docs:
        for _, a in Q[:12] + [(0, ""), (0, "eeee"), (0, "ab" * 150)]:
            m = SequenceMatcher(None, a, b)
            if m.bpopular:
                assert m.ratio() * (len(a) + len(b)) / 2 <= sim._can_match(a, b, m.b2j) + 1e-6
    queries = Q[:6] + [(777, ""), (778, "ab" * 150)]
    q = spark.createDataFrame(queries, "qid long, text string").unionByName(spark.createDataFrame([(779, None)], "qid long, text string"))
    d = spark.createDataFrame(docs + [(9006, None)], "id long, text string")
    got = sim.sequence_topk(q, d, K)
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()
    exp = brute(queries, docs, lambda a, b: SequenceMatcher(None, a, b).ratio())
    assert sorted(tuple(r) for r in got.collect()) == exp


def test_set_topk_makes_no_row_per_pair(spark, data):
    """Top k by sets: no join of exploded tokens in the plan, and the result of the token join."""
    q, d, _, _ = data
    for top, items, least in ((sim.jaccard_topk, sim.tokens, None), (sim.trigram_topk, sim.trigrams, 0.1)):
        got = top(q, d, K)
        assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
        s = sim.set_similarity(q, d, items("text"), items("text"), min_score=least)
        want = sim.top_k(s if least is None else s.where(F.col("score") > least), K).select(
            "qid", "id", sim.percentage(F.col("score")).alias("percentage"), "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_set_topk_odd_rows(spark, monkeypatch):
    """Nulls, empty texts, ties, a null id, one long text, repeated ids; small and large query sides agree."""
    q = spark.createDataFrame([(1, "the cat sat"), (2, ""), (3, None), (4, "zzz"), (5, " ".join(f"w{i}" for i in range(400)))], "qid long, text string")
    rows = [(i, "the cat") for i in range(9, 0, -1)] + [(None, "the cat"), (20, None), (21, ""), (22, " ".join(f"w{i}" for i in range(3000)))]
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    twice = d.union(spark.createDataFrame([(3, "the cat")], d.schema))
    for docs in (d, twice, d.limit(0)):
        for queries in (q, q.limit(0)):
            got = {}
            for cells in (1 << 26, -1):
                monkeypatch.setattr(sim, "TABLE_CELLS", cells)
                got[cells] = [sorted(map(str, f(queries, docs, 4).collect())) for f in (sim.jaccard_topk, sim.trigram_topk)]
            assert got[1 << 26] == got[-1]
    monkeypatch.setattr(sim, "TABLE_CELLS", 1 << 26)
    assert [(r.id, r.rank) for r in sim.jaccard_topk(q, d, 4).where("qid = 1").orderBy("rank").collect()] == [(None, 1), (1, 2), (2, 3), (3, 4)]
