import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.llm import topk_search


def spec(rows, k=5):
    vec = []
    for n, (i, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x) for x in e) and math.hypot(*e) < 2 ** 54:
            vec.append((i, [math.floor(256 * x) for x in e], n))
    out = []
    for qi, q, qn in vec:
        if qi is None or qi % 50:
            continue
        s = sorted(((-sum(a * b for a, b in zip(q, v)), vi is None, vi or 0, n) for vi, v, n in vec if n != qn and len(v) == len(q)))
        out += [(qi, r + 1, None if x[1] else x[2], max(-2 ** 63, min(2 ** 63 - 1, -x[0]))) for r, x in enumerate(s[:k])]
    return Counter(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    df = df.select("*", F.lit(1).alias("norm"), F.lit(2).alias("rid"), F.lit(3).alias("vec"), F.lit(4).alias("id"))
    got = topk_search.top_products(df, F.col("id") % 50 == 0, **options).collect()
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_odd_vectors(spark, chunk):
    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.gauss(0, rnd.choice((0.1, 1, 5))) for _ in range(4)]) for i in range(0, 120)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [nan, 0.0, 0.0, 0.0]), (350, [inf, 0.0, 0.0, 0.0]),
             (400, [0.0] * 4), (450, []), (451, []), (500, [1.0, 2.0]), (None, [9.0, 9.0, 9.0, 9.0]),
             (50, [1.0, 1.0, 1.0, 1.0]), (50, [1.0, 1.0, 1.0, 1.0]), (600, [1e6, 3e6, 1e6, 1.0]),
             (601, [1e6, 3e6, 1e6, 2.0]), (602, [1e6, 3e6, 1e6, 1.004]), (650, [1e12, 1e12, 0.0, 0.0])]
    assert run(spark, rows, chunk=chunk) == spec(rows)


def test_near_parallel_vectors_use_coordinate_pruning(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice((1, 2, 3)) * x for x in (0.9 + rnd.gauss(0, 0.02), rnd.gauss(0, 0.05), rnd.gauss(0, 0.05), -0.4)])
            for i in range(400)]
    rows += [(i, [-x for x in r[1]]) for i, r in zip(range(400, 500), rows)]
    assert run(spark, rows, chunk=64) == spec(rows)


def test_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)]
    assert run(spark, rows, chunk=16) == spec(rows)


def test_empty(spark):
    assert run(spark, []) == Counter()


@pytest.mark.parametrize("bits", [30, 45, 61])
def test_large_products_are_compared_exactly(spark, bits):
    """Products above 2^53, and above a long, that differ by little."""
    rnd = random.Random(bits)
    rows = [(i, [rnd.randint(2 ** (bits - 1), 2 ** bits) / 256 if bits < 50 else rnd.randint(2 ** 40, 2 ** 41) * 2.0 ** (bits - 50)
                 for _ in range(4)]) for i in range(300)]
    base = rows[7][1]
    rows += [(i, [x + rnd.randint(-2, 2) * 2.0 ** max(-8, bits - 60) for x in base]) for i in range(300, 700)]
    assert run(spark, rows, chunk=64) == spec(rows)


def test_float_bounds_in_runs(monkeypatch):
    """The probe: components of 2^29 to 2^30 in four dimensions, short runs."""
    monkeypatch.setattr(topk_search, "RUN", 8)
    for seed in range(60):
        rnd = np.random.default_rng(seed)
        v = rnd.integers(2 ** 29, 2 ** 30, (120, 4))
        v[60:] = v[0] + rnd.integers(-3, 4, (60, 4))
        q = v[:10] + rnd.integers(-2, 3, (10, 4))
        ids = np.arange(120)
        got = topk_search.search_chunk(v, ids, ids, q, np.arange(1000, 1010), np.full(10, -np.inf), 5)
        for (places, score), one in zip(got, q.tolist()):
            want = sorted((-sum(a * b for a, b in zip(one, x)), i) for i, x in enumerate(v.tolist()))[:5]
            assert [(-int(s), int(p)) for p, s in zip(places, score)] == want
