import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeshore.llm import lm_scoring
from lakeshore.llm.queries import fold


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def spec(rows, m=lm_scoring.WEIGHT):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    toks = [tokens(r[1]) for r in rows]
    c, c2 = Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            c.update(t)
            c2.update(zip(["", *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for r, t, h in zip(rows, toks, held):
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10((c2[u, w] + m * p(w)) / (c[u] + m)) for u, w in zip(["", *t[:-1]], t))
        out.append((str(r[0]), h, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("block", [500, 6 << 20])
def test_scores(odd, odd_rows, clash, block):
    got = lm_scoring.score_documents(clash(odd), lambda i: fold(i) != 1, block_bytes=block).collect()
    got = sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = spec(odd_rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_next_token_probabilities_sum_to_one(spark):
    docs = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a", "a"])]
    vocab = ["a", "b", "c", "", "unseen"]
    probes = [(100 + i, f"a {w}".strip()) for i, w in enumerate(["a", "b", "c", "unseen"])]
    df = spark.createDataFrame(docs + probes + [(200, "a")], "doc_id bigint, text string")
    got = {r["id"]: r["score"] for r in lm_scoring.score_documents(df, lambda i: i < 100).collect()}
    rows = {i: t for i, t in docs + probes + [(200, "a")]}
    c, c2 = Counter(), Counter()
    for i, t in docs:
        c.update(tokens(t))
        c2.update(zip(["", *tokens(t)[:-1]], tokens(t)))
    n, v = sum(c.values()), len(c)
    p = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in vocab}
    after_a = {w: (c2["a", w] + lm_scoring.WEIGHT * p[w]) / (c["a"] + lm_scoring.WEIGHT) for w in vocab}
    assert sum(after_a.values()) == pytest.approx(1) and len(rows) == len(got)


def test_model_beats_base_on_held_out(spark, sf01):
    df = lm_scoring.score_documents(spark.read.parquet(f"{sf01}/documents.parquet"), lambda i: fold(i) != 1)
    r = df.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.2


def test_empty_and_untrained(spark, empty):
    assert lm_scoring.score_documents(empty, lambda i: fold(i) != 1).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = lm_scoring.score_documents(df, lambda i: F.lit(False)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and all(r["n_known"] == 0 for r in rows)
