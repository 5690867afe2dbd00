import random
from collections import defaultdict

import numpy as np
import pytest

from lakeshore.llm import packing
from lakeshore.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(tokenizer_path())


def test_ids_are_those_of_the_tokenizer(tokenizer, odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["don't I'll 3rd café ﬁ x<|endoftext|>y", "日本語 テスト!!", "½ x²  ﬂ—“q”", "é ́x"]
    for t, e in zip(texts, tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert tokenizer(t).tolist() == e.ids


def cost(cuts, flags, width):
    total, start = 0, 0
    for c in cuts:
        n = c - start
        total += 0 if n & (n - 1) == 0 else width - n
        total += 0 if flags[c - 1] == 2 else packing.SENTENCE if flags[c - 1] == 1 else packing.INSIDE
        start = c
    return total


def best(flags, width):
    place = [0, *[i + 1 for i, f in enumerate(flags) if f or i + 1 == len(flags)]]
    f = {0: 0}
    for j in place[1:]:
        options = []
        for i in place:
            if i < j and j - i <= width and i in f:
                n = j - i
                free = n == width or n in (width // 2, width // 4)
                options.append(f[i] + (0 if free else width - n))
        pen = 0 if flags[j - 1] == 2 else packing.SENTENCE if flags[j - 1] == 1 else packing.INSIDE
        if options:
            f[j] = min(options) + pen
    return f[len(flags)]


def test_cuts_are_optimal():
    rnd = random.Random(4)
    for _ in range(200):
        width = 16
        flags = np.array([rnd.choices((0, 1, 2), (8, 2, 1))[0] for _ in range(rnd.randint(1, 120))], np.int8)
        flags[::7] = 1
        flags[-1] = 2
        cuts = packing.cut_stream(flags, width)
        assert cuts[-1] == len(flags) and all(0 < b - a <= width for a, b in zip([0, *cuts], cuts))
        assert cost(cuts, flags, width) <= best(flags.tolist(), width)


def whole(rows, texts, tokenizer, width=4096):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], ids))
        docs[(r["id"], r["doc_tokens"])].append((r["start"], ids))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, ids in sorted(pieces):
            assert offset == at
            at += len(ids)
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return docs, padding


def test_round_trip(odd, odd_rows, tokenizer, clash):
    rows = packing.pack(clash(odd), tokenizer_path()).collect()
    docs, padding = whole(rows, odd_rows, tokenizer)
    want = defaultdict(list)
    for r in odd_rows:
        ids = tokenizer(r[1]).tolist() + [2]
        want[(r[0], len(ids))].append(ids)
    assert {k: sum(len(i) for _, i in v) for k, v in docs.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for key, pieces in docs.items():
        if len(want[key]) == 1:
            assert [x for _, ids in sorted(pieces) for x in ids] == want[key][0]
            assert [s for s, _ in sorted(pieces)] == np.cumsum([0, *[len(i) for _, i in sorted(pieces)]])[:-1].tolist()
    assert padding <= 0.02 * sum(r["length"] for r in rows)


def test_small_horizon_keeps_every_token():
    rnd = np.random.default_rng(1)
    docs = []
    for i in range(300):
        ids = rnd.integers(3, 99, rnd.integers(1, 400)).astype("<u4")
        flags = (rnd.random(len(ids)) < 0.1).astype(np.int8)
        flags[-1] = 2
        docs.append((i, ids, flags))
    pieces = list(packing.pack_stream(iter(docs), width=64, horizon=1024))
    assert [p[0] for p in pieces] == sorted(p[0] for p in pieces)       # order is preserved
    for i, ids, _ in docs:
        assert np.concatenate([p[2] for p in pieces if p[0] == i]).tolist() == ids.tolist()
    assert [p[4] for p in pieces] == sorted(p[4] for p in pieces)


def test_whole_table(spark, sf01, tokenizer):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    rows = packing.pack(docs, tokenizer_path()).collect()
    found, padding = whole(rows, None, tokenizer)
    total = sum(r["length"] for r in rows)
    assert padding < 0.01 * total
    for r in docs.collect():
        ids = tokenizer(r["text"]).tolist() + [2]
        assert [x for _, p in sorted(found[(r["doc_id"], len(ids))]) for x in p] == ids


def test_empty(empty):
    assert packing.pack(empty, tokenizer_path()).count() == 0
