import hashlib
import re
from collections import Counter, defaultdict

import pytest

from lakeshore.llm import mixing


def targets(sizes):
    """Reshare the excess by weight until no target is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(o["words"] for o in r["occurrences"])
        assert all(0 <= o["position"] <= 1 for o in r["occurrences"])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, abs=1)


def test_mix(odd, odd_rows, clash):
    for df in (odd, clash(odd)):
        check(odd_rows, mixing.mix(df).collect())


def test_reruns_agree(odd):
    a = mixing.mix(odd).select("id", "key", "taken", "occurrences").collect()
    b = mixing.mix(odd.repartition(5)).select("id", "key", "taken", "occurrences").collect()
    assert Counter(map(str, a)) == Counter(map(str, b))


def test_documents(odd, odd_rows, clash):
    df = clash(odd)
    plan = mixing.mix(odd).collect()
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got.collect())
    assert words == sum(r["taken"] for r in plan)
    assert got.count() == sum(len(r["occurrences"]) for r in plan)


def test_schedule_inverse(spark):
    from pyspark.sql import functions as F
    for knots in mixing.SCHEDULES:
        rows = spark.range(101).select((F.col("id") / 100).alias("x")).select("x", mixing.invert_schedule(knots, F.col("x")).alias("t"))

        def integral(t):
            out = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                u = min(max(t, t0), t1) - t0
                out += w0 * u + (w1 - w0) / (t1 - t0) * u * u / 2
            return out
        for r in rows.collect():
            assert integral(r["t"]) / integral(1) == pytest.approx(r["x"], abs=1e-9)


def test_order_is_a_fixed_hash():
    assert hashlib.md5(b"12").hexdigest().startswith("c20")


def test_empty(empty, clash):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix_documents(clash(empty)).count() == 0


def test_texts_cross_the_network_once_before_the_sort(spark, odd):
    """With tables too large to broadcast, whole rows are shuffled once to meet their places and once by the sort."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix_documents(odd)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        got = mixed.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sum(len(r["occurrences"]) for r in mixing.mix(odd).collect())
    assert len(re.findall(r"Exchange rangepartitioning\(", plan)) == 1
    # The texts, and the plan to meet them (grouped by the same key).
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 2
