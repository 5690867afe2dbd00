import glob
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.llm import quality
from lakeshore.llm.common import DROP_SHUFFLES, materialise
from lakeshore.llm.queries import QUERIES
from lakeshore.session import checkpoint_root


def spec_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    tri = Counter()
    for t in texts:
        s = ["<", "<", *t.split(), ">"]
        tri.update(zip(s, s[1:], s[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def smooth(counts, context):
        d = quality._discounts(np.array(list(counts.values())))
        total, mass = Counter(), defaultdict(float)
        for g, n in counts.items():
            total[context(g)] += n
            mass[context(g)] += d[min(n, 3)]
        return (lambda g: (counts[g] - d[min(counts[g], 3)]) / total[context(g)] if counts[g] else 0.0,
                lambda x: mass[x] / total[x] if total[x] else 1.0, total)
    s3, w3, t3 = smooth(tri, lambda g: g[:2])
    s2, w2, _ = smooth(bi, lambda g: g[0])
    s1, w1, _ = smooth(uni, lambda g: 0)
    size = len({x for g in tri for x in g}) + 1

    def p(a, b, c):
        p1 = s1(c) + w1(0) / size
        p2 = s2((b, c)) + w2(b) * p1
        return s3((a, b, c)) + w3((a, b)) * p2 if t3[(a, b)] else p2
    return p, {x for g in tri for x in g}


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abcdefg", (9, 7, 5, 3, 2, 1, 1), k=rnd.randint(1, 15))) for _ in range(60)]
    grams = Counter()
    for t in texts:
        h = [quality._hash(w.encode()) for w in t.split()]
        s = [quality.BEGIN, quality.BEGIN, *h, quality.END]
        grams.update(zip(s, s[1:], s[2:]))
    a, b, c = (np.array(x) for x in zip(*grams))
    return texts, quality.Model.fit(a, b, c, np.array(list(grams.values())))


def test_probabilities(model):
    texts, m = model
    p, _ = spec_model(texts)
    for t in [*texts[:20], "", "a zz b", "zz", "g g g g g", "a"]:
        s = ["<", "<", *t.split(), ">"]
        want = sum(math.log10(p(*g)) for g in zip(s, s[1:], s[2:]))
        assert m.log10(quality._hashes([t]))[0] == pytest.approx(want, rel=1e-5)


def test_sums_to_one(model):
    texts, _ = model
    p, vocabulary = spec_model(texts)
    for a, b in (("a", "b"), ("g", "f"), ("<", "a"), ("zz", "a")):
        assert sum(p(a, b, c) for c in [*vocabulary, "unseen"]) == pytest.approx(1)


def test_edge_rows(spark, odd, odd_rows, clash, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, 1, 0), (41, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.judge(clash(odd), labels).collect()
    assert Counter(r["id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert all(r["perplexity"] > 0 and r["threshold"] is not None for r in rows)
    none = quality.judge(odd, labels.filter("false")).collect()
    assert all(r["kept"] and r["threshold"] is None for r in none)
    assert quality.judge(empty, labels).count() == 0


def test_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.95 and rate[0] < 0.5


def test_long_document_and_rare_language(spark):
    """A long text that comes first leaves room for others; a language with few of many trusted rows has its threshold."""
    rnd = random.Random(3)
    text = lambda words, n=30: " ".join(rnd.choices(words, k=n))
    rows = [(i, text("abcdefg", 4000 if i % 9 == 0 else 30), "en") for i in range(1500)]
    rows += [(i, text("pqrstuv"), "xx") for i in range(2000, 2150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id bigint, quality int, toxic int")
    args = docs, labels, "doc_id", "text", "lang", "quality"
    got = quality.training_sample(*args, documents=200, words=3000).collect()
    sizes = [len(r["text"].split()) for r in got]
    assert 2900 < sum(sizes) <= 3000 and max(sizes) <= 3000 // quality.PART
    assert {r["text"] for r in got} <= {r[1] for r in rows}             # whole texts only
    assert {r["text"][0] in "abcdefg" for r in got} == {True, False}
    judged = quality.judge(docs, labels, documents=200, words=3000)
    threshold = {r["lang"]: r["threshold"] for r in judged.select("lang", "threshold").distinct().collect()}
    assert threshold["en"] != threshold["xx"] and None not in threshold.values()


def test_all_trusted_text_trains(spark):
    """More documents than a broadcast sample took, a long text, equal texts and repeated rows: every perplexity is
    that of one model of all training texts, however the blocks fall."""
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choices("abcdefgh", (9, 7, 5, 3, 2, 1, 1, 1), k=n))
    rows = [(i, text(rnd.randint(1, 8)), rnd.choice(["en", "de", None])) for i in range(9000)]
    rows += [(9000 + i, text(40_000), "en") for i in range(3)] + rows[:20] + [(9900, "", "en"), (9901, None, None), (9902, "zz a", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(9003)], "doc_id bigint, quality int, toxic int")
    fold = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))).distinct().collect()}
    first = {}
    for i, t, _ in rows:
        if i < 9003 and i % 9:
            first[t] = min(i, first.get(t, i))
    training = [t for t, i in first.items() if fold[i]]
    grams = Counter()
    for h in quality._hashes(training):
        s = [quality.BEGIN, quality.BEGIN, *h.tolist(), quality.END]
        grams.update(zip(s, s[1:], s[2:]))
    m = quality.Model.fit(*(np.array(x) for x in zip(*grams)), np.array(list(grams.values())))
    texts = sorted({t or "" for _, t, _ in rows})
    want = dict(zip(texts, m.log10(quality._hashes(texts))))
    by_id = {i: t or "" for i, t, _ in rows}
    for options in ({}, {"block_bytes": 30_000}):
        got = quality.judge(docs, labels, **options).collect()
        assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
        for r in got:
            t = by_id[r["id"]]
            assert r["n_tokens"] == len(t.split()) + 1
            assert math.log10(r["perplexity"]) * -r["n_tokens"] == pytest.approx(want[t], rel=1e-5)


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count")
    written = materialise(rows, "test-shuffles")
    for _ in range(50):         # they go in the background
        if files() - before:
            time.sleep(0.1)
    assert not files() - before
    assert written.count() == 7
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"
    assert sorted(r["count"] for r in rows.collect()) == [142] + [143] * 6


def test_turns_ask_for_every_ngram_once():
    """A pass shuffles a part of the n-grams only; together they ask what the scored block looks up, in its order."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 60, 300)
    tokens = (500 * rng.random(lengths.sum()) ** 2).astype(np.uint64) + np.uint64(3)
    tokens[np.cumsum(lengths) - 1] = quality.END
    learnt = rng.random(300) < 0.8
    row = {"tokens": quality._pack(tokens), "lengths": quality._pack(lengths), "learnt": quality._pack(learnt)}
    block, shards = quality.Block.of(row), 9
    asked, pairs, counts = {}, {}, []
    for turn in range(quality.PASSES):
        part = quality.Turn(row, turn)
        mine = dict(part.triples(shards))
        assert mine and not mine.keys() & asked.keys()
        asked |= mine
        counts.append(sum(int(x[3].sum()) for x in mine.values()))
        codes = part.pairs(turn)
        pairs |= {s: codes[at] for s, at in quality._by_shard(quality._pairs_shard(codes, shards))}
    assert sum(counts) == lengths[learnt].sum() and max(counts) < 0.6 * sum(counts)
    wanted = {s: (p, t) for s, p, t in block.by_context(shards)}
    assert wanted.keys() == asked.keys()
    for s, (places, triples) in wanted.items():
        assert np.array_equal(block.pairs[block.contexts[places]], asked[s][0]) and np.array_equal(block.fan[places], asked[s][1])
        assert np.array_equal(block.last[triples], asked[s][2])
    wanted = {s: block.pairs[at] for s, at in quality._by_shard(quality._pairs_shard(block.pairs, shards))}
    assert wanted.keys() == pairs.keys() and all(np.array_equal(wanted[s], pairs[s]) for s in wanted)


def test_tables_on_the_way_are_removed(spark, odd):
    folder = f"{checkpoint_root(spark).removeprefix('file:')}/lakeshore"
    before = set(glob.glob(f"{folder}/*"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(odd, labels, block_bytes=2000)
    left = {d.rsplit("/", 1)[1].rsplit("-", 1)[0] for d in set(glob.glob(f"{folder}/*")) - before}
    assert left == {"trusted-keys", "perplexity"}
    assert got.count() == odd.count()
