import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.llm import alignment, queries


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))


def tokens(aligner, text):
    """Ids and decoded bytes of whole texts, from ids alone."""
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    return a, [aligner.bytes_a[i] for i in a], b, [aligner.bytes_b[i] for i in b]


def brute(aligner, texts):
    """Groups, and every overlap by comparing all byte ranges."""
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, raw_a, b, raw_b = tokens(aligner, text)
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            rows.append(None)
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            part = [",".join(str(x) for x, (s, e) in zip(ids, sp) if low <= s and e <= cut) for ids, sp in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(part))
            low = cut
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(pairs)
        rows.append((len(a), len(b), groups, pairs))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(count[p] == best[p[1]] for p in r[3]),
                                    sum(count[p] for p in r[3]), ";".join(r[2])) for r in rows]


TEXTS = ["Hello, world! don't stop", "日本語 テスト 😀😀 á", "a  b   c\n\n d\te \r\n f ", " lead", "   ", "\n", " ", "x" * 300,
         "<|endoftext|> <s> </s> <unk> <0x41>", "no ▁ here", "½ ﬁ \x00 \x1c\x85\xa0 !\x1c x", None, "", "Hello, world! Hello, world!",
         "don't퟿", "​﻿", "é \U0010ffff", "1234567890 12,345.67"]


def test_byte_ends_refine_coarse_spans():
    def ends(spans, decoded):
        spans = np.array(spans)
        return alignment.byte_ends(spans[:, 0], spans[:, 1], np.array([len(x) for x in decoded])).tolist()
    # One character of four bytes in three tokens: the spans of all cover the whole character.
    assert ends([(0, 1), (1, 5), (1, 5), (1, 5), (5, 6)], [b"a", b"\xf0", b"\x9f\x98", b"\x80", b"b"]) == [1, 2, 4, 5, 6]
    # Byte fallback: empty spans before the last byte.
    assert ends([(0, 0), (0, 0), (0, 3)], [b"\xe2", b"\x96", b"\x81"]) == [1, 2, 3]


def test_stretches_align_like_whole_texts(aligner):
    for text in [t for t in TEXTS if t]:
        a, raw_a, b, raw_b = tokens(aligner, text)
        found = aligner.align(aligner.stretches(text))
        sound = b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()
        assert (None not in found) == sound
        if sound:
            sides = [g.split("|") for x in found for g in x.groups.split(";")]
            assert ",".join(s[0] for s in sides) == ",".join(map(str, a))
            assert ",".join(s[1] for s in sides) == ",".join(map(str, b))


def test_query_equals_brute_force(spark, aligner, odd, odd_rows, clash):
    texts = [r[1] for r in odd_rows if r[1] is None or len(r[1]) < 3000] + TEXTS
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    expected = {(i, *r) for i, r in enumerate(brute(aligner, texts))}
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    for block in (1, 2000, alignment.BLOCK):
        got = alignment.align(clash(docs).drop("id").withColumn("id", F.lit("extra")), *paths, block=block)
        assert {(r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()} == expected


def test_digest_nulls_and_long_texts(spark, odd, odd_rows, empty, clash):
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    got = alignment.align(clash(odd), *paths, digest=True)
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    plain = {(r.id, r.n_a, r.n_links): r.groups for r in alignment.align(odd, *paths).collect()}
    for r in rows:
        text = plain[r.id, r.n_a, r.n_links]
        assert r.groups == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert r.n_groups == (text.count(";") + 1 if text else 0)
    assert alignment.align(empty, *paths).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in alignment.align(nothing, *paths).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 3


def test_query_over_the_whole_table(spark, sf01, aligner):
    rows = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op13_alignment"](spark, sf01).collect()}
    assert len(got) == len(rows)
    for doc_id, text in [tuple(r) for r in rows if r.text][:60]:
        a, _, b, _ = tokens(aligner, text)
        assert (got[doc_id].n_a, got[doc_id].n_b) == (len(a), len(b))
    assert all(r.n_best <= r.n_links <= r.count_sum for r in got.values())
