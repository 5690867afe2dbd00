import random

import numpy as np
import xxhash

from lakeshore.llm import simhash


def spec_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    out = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << b
    return out


def spec_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (low.get(r) is None or d < low[r]):
            low[r] = d
    return [low.get(find(i)) for i in range(len(fps))]


def test_fingerprint(odd_rows):
    for row in odd_rows[:55]:
        if row[1] is None or len(row[1]) < 10_000:
            assert simhash.fingerprint(row[1]) == spec_fingerprint(row[1])
    assert simhash.fingerprint("A b C d e F") == simhash.fingerprint("a B\tc d\ne f")


def test_trie_join_matches_all_pairs():
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    keys = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) & (2 ** 64 - 1) for b in base for _ in range(12)})
    arr = np.array(keys, np.uint64)
    for exact, bits in ((0, 4), (0, 0), (0, 9), (12, 4)):
        got = {(int(i), int(j)) for a, b in simhash.trie_self_join(arr, bits, exact) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys))
                if (keys[i] ^ keys[j]).bit_count() <= bits and (not exact or keys[i] >> 64 - exact == keys[j] >> 64 - exact)}
        assert got == want


def test_components_match_brute_force(spark, odd, odd_rows, clash):
    want = spec_components([simhash.fingerprint(r[1]) for r in odd_rows], [r[0] for r in odd_rows])
    got = simhash.near_duplicates(clash(odd)).collect()
    assert sorted(map(str, [(r["id"], r["fp"] & (2 ** 64 - 1), r["component"]) for r in got])) == sorted(
        map(str, [(r[0], simhash.fingerprint(r[1]), w) for r, w in zip(odd_rows, want)]))


def test_planted_fingerprints_every_choice_of_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        g = f
        for _ in range(4):          # chains of near fingerprints
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    want = spec_components(fps, fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    choices = simhash._choices
    for size, cell in ((1, 16_384), (10 ** 8, 16_384), (1, 3)):     # few blocks, many blocks, cut sub-tries
        monkeypatch.setattr(simhash, "_choices", lambda bits, n, size=size: choices(bits, size))
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, cell)).collect()}
        group = {}
        for f, s, w in zip(fps, signed, want):
            group.setdefault(roots.get(s, s), set()).add(w)
        assert all(len(v) == 1 for v in group.values()) and len(group) == len(set(want))


def test_one_of_each_group_stays(odd, odd_rows, clash):
    df = clash(odd)
    rows = simhash.dedup_documents(df)
    assert rows.columns == df.columns
    fps = [simhash.fingerprint(r["text"]) for r in rows.collect()]
    all_ = spec_components([simhash.fingerprint(r[1]) for r in odd_rows], list(range(len(odd_rows))))
    assert len(fps) == len(set(all_)) and len(set(spec_components(fps, list(range(len(fps)))))) == len(fps)


def test_empty(empty, clash):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup_documents(clash(empty)).count() == 0
