import pickle
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeshore.llm import toxicity
from lakeshore.llm.queries import QUERIES


def test_search_is_exact():
    rnd = random.Random(1)
    found = [{rnd.randrange(40): rnd.randint(1, 5) for _ in range(rnd.randint(0, 8))} for _ in range(700)]
    labels = [rnd.randrange(2) for _ in found]
    frequency = {t: rnd.randint(1, 90) for t in range(40)}
    index = toxicity.build_index(list(range(700)), found, labels, [1.0] * 700, frequency, 100, 0.1)
    for f in found[:150]:
        at, w = index.vector(f)
        every = np.array([w @ index.weights[at, j].astype(float) if len(at) else 0.0 for j in range(700)])
        order = [j for j in np.lexsort((np.arange(700), -every)) if every[j] > 0][:toxicity.NEIGHBOURS]
        i, c = index.neighbours(at, w)
        assert np.allclose(c, every[order]) and set(i[c > c.min(initial=0) + 1e-9]) <= set(order)


def test_terms():
    got = toxicity.terms("Loser, loser! Losers")
    assert got["loser"] == 2 and got["losers"] == 1 and got["lose*"] == 3 and got["loser*"] == 1


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(2)
    clean = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(rnd.randint(5, 200)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = clean()
        if toxic:
            ws = text.split()
            for _ in range(4):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(["nasty", "vile", "grossly", "foulmouth"]))
            text = " ".join(ws)
        rows.append((i, text, "en", "s", 1))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "nasty vile", "en", "s", 1), (5, rows[5][1], "en", "s", 1),
             (1002, "x" * 60_000, "en", "s", 1)]
    labels += [(0, 1, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (9, 1, 7)]
    return rows, labels


def test_scores(spark, planted, clash):
    rows, labels = planted
    docs = clash(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["id"]: r["score"] for r in got}
    wrong = [i for i in range(600) if (score[i] >= 0.5) != (i % 6 == 0)]
    assert len(wrong) <= 6
    assert score[1000] == score[1001] < 0.2 and score[None] > 0.5 and score[1002] < 0.2
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["score"] < 0.5 for r in got)


def test_without_labels_or_documents(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(odd, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(odd, one).collect()} == {1.0}
    assert toxicity.score_documents(empty, one).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = got.join(labels, "doc_id").filter("held_out and toxic is not null")
    r = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
                 F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
                 F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["right"] > 0.97 and r["recall"] > 0.9 and r["false"] < 0.02


def test_all_terms_of_the_examples_count(spark):
    """Few toxic labels, words that clean texts hold too, and a word of one example."""
    rnd = random.Random(8)
    filler = lambda: ["".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(8)]
    weak = ["daft", "silly", "dull"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 20 == 0
        ws = filler() + (rnd.sample(weak, 2) if toxic else [rnd.choice(weak)] if i % 16 == 1 else ["calm"])
        rows.append((i, " ".join(ws + ["onlyhere"] * (i == 120))))
        labels.append((i, 1, int(toxic)))
    rows += [(i, " ".join(filler() + (weak if i < 1010 else ["calm"]))) for i in range(1000, 1020)] + [(2000, "onlyhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    index, _ = toxicity.fit(docs, marks)
    assert len(index.vocabulary) == len(set().union(*[toxicity.terms(t) for i, t in rows if i < 400]))
    got = {r["id"]: r for r in toxicity.score_documents(docs, marks).collect()}
    assert sum((got[i]["score"] >= 0.5) == (i < 1010) for i in range(1000, 1020)) >= 18
    assert got[2000]["neighbours"] == [120]


def _brute_scores(docs, marks, k=toxicity.NEIGHBOURS):
    """Scores by definition: dense TF-IDF vectors over words and prefixes, all
    cosines, votes, and the isotonic fit by its max-min formula."""
    terms = {i: toxicity.terms(t) for i, t in docs}
    vocabulary = sorted(set().union(*[terms[i] for i in marks]))
    has = {t: {i for i in terms if t in terms[i]} for t in vocabulary}
    n = {y: sum(v == y for v in marks.values()) for y in (0, 1)}

    def weight(t):
        p, q = [(sum(i in has[t] for i in marks if marks[i] == y) + 0.5) / (n[y] + 1) for y in (1, 0)]
        apart = abs(p - q) / (p * (1 - p) / n[1] + q * (1 - q) / n[0]) ** 0.5 + 1e-3
        return (np.log((len(docs) + 1) / (len(has[t]) + 1)) + 1e-3) * apart

    each = np.array([weight(t) for t in vocabulary])
    vectors = {i: each * [1 + np.log(c[t]) if t in c else 0 for t in vocabulary] for i, c in terms.items()}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in vectors.items()}

    def vote(i):
        near = sorted(((-round(unit[i] @ unit[j], 12), j) for j in marks if j != i), key=lambda x: x[0])[:k]
        near = [(-c, j) for c, j in near if c < 0]
        total = sum(c ** toxicity.SHARPNESS for c, _ in near)
        return sum(c ** toxicity.SHARPNESS * marks[j] for c, j in near) / total if near else None

    points = {}
    for i in marks:
        if vote(i) is not None:
            points.setdefault(vote(i), []).append(marks[i])
    xs = sorted(points)
    total, size = np.array([sum(points[x]) for x in xs], float), np.array([len(points[x]) for x in xs], float)
    mean = lambda a, b: total[a:b + 1].sum() / size[a:b + 1].sum()
    fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    knots = {}
    for x, y, s in zip(xs, fit, size):
        knots.setdefault(round(y, 9), []).append((x, s))
    at = [sum(x * s for x, s in knots[y]) / sum(s for _, s in knots[y]) for y in sorted(knots)]
    return {i: float(np.interp(vote(i) or 0.0, at, sorted(knots))) for i in terms}


def test_scores_by_brute_force(spark):
    rnd = random.Random(11)
    common = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    docs, marks = [], {}
    for i in range(160):
        toxic = i % 4 == 0
        ws = [rnd.choice(common) for _ in range(rnd.randint(8, 40))] + ([rnd.choice(["vile", "nastily", "dull"])] * rnd.randint(0, 2) if toxic else [])
        docs.append((i, " ".join(ws)))
        if i % 5:
            marks[i] = int(toxic)
    docs += [(500, "unseen words only"), (501, "")]
    want = _brute_scores(docs, marks)
    got = {r["id"]: r["score"] for r in toxicity.score_documents(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame([(i, 1, y) for i, y in marks.items()], "doc_id bigint, quality int, toxic int")).collect()}
    assert got.keys() == want.keys()
    assert len({round(s, 6) for s in want.values()}) > 10
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_driver_builds_no_index(spark, planted, monkeypatch):
    """The index is made in a task, and inverted where documents are scored: only its bytes pass through the driver."""
    rows, labels = planted
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")

    def not_here(self):
        raise AssertionError("inverted in the driver")
    monkeypatch.setattr(toxicity.Index, "invert", not_here)
    assert toxicity.score_documents(docs, marks).filter("score >= 0.5").count() > 90


def test_inverting_the_index_takes_little_memory():
    """A worker inverts the index beside its documents: what that needs stays near what the index holds."""
    rng = np.random.default_rng(3)
    found = [np.sort(rng.choice(60_000, 300, replace=False)) for _ in range(1500)]
    index = toxicity.build_index(list(range(1500)), [(f, np.ones(300, np.int64)) for f in found], [i % 2 for i in range(1500)],
                                 [1.0] * 1500, np.full(60_000, 3), 5000, 0.5)
    want = index.neighbours(*index.vector((found[7], np.ones(300, np.int64))))
    data = pickle.dumps(index.__getstate__())
    del index
    tracemalloc.start()
    index = toxicity._load([data]).ready()
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 37e6 and most < 1.25 * held
    got = index.neighbours(*index.vector((found[7], np.ones(300, np.int64))))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
