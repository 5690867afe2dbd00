import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeshore.llm import packing, simhash, toxicity
from lakeshore.llm.common import materialise
from lakeshore.llm.queries import tokenizer_path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf01), f"test-{name}"))
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]


def test_each_stage_on_its_own_input(spark, sf01, stages):
    docs, clean, once, apart, mixed, packed = stages
    for s in stages[1:5]:
        assert s.columns == docs.columns
    score = {r["key"]: r["score"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{sf01}/labels.parquet")).collect()}
    keys = docs.select("doc_id", F.xxhash64("text").alias("k")).collect()
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in keys if score[r["k"]] < 0.5}
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    best = {}
    for r in clean.collect():
        k = (-len(r["text"]), r["doc_id"])
        best[digest(r["text"])] = min(best.get(digest(r["text"]), k), k)
    assert {r["doc_id"] for r in once.collect()} == {d for _, d in best.values()}
    rows = once.collect()
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    arr = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 4):
            root[find(i)] = find(int(j))
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r["doc_id"]), r["doc_id"])
    assert Counter(r["doc_id"] for r in apart.collect()) == Counter(low.values())
    size = {r["doc_id"]: len(words(r["text"])) for r in apart.collect()}
    took = Counter()
    for r in mixed.collect():
        took[r["doc_id"]] += len(words(r["text"]))
    assert all(took[d] <= 2 * n for d, n in size.items())
    assert sum(took.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.001)
    tokenizer = packing.WordTokenizer(tokenizer_path())
    want = sum(len(tokenizer(r["text"])) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_run_gives_the_last_stage(spark, sf01, stages):
    got = corpus_pipeline.run(spark, sf01)
    assert got.columns == stages[-1].columns
    assert got.agg(F.sum("length")).first()[0] == stages[-1].agg(F.sum("length")).first()[0]


def test_stages_on_odd_rows(spark, odd, empty, clash, sf01):
    for start in (odd, clash(odd), empty):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialise(stage(spark, docs, sf01), f"odd-{name}")
            if i < 4:
                assert docs.columns == start.columns
        if start is empty:
            assert docs.count() == 0


def test_packing_follows_the_curriculum_over_many_files(spark, sf01):
    rows = [(i, "word " * (5 + 40 * (i // 10)), "en", "s", 1) for i in range(80)]     # later files are larger
    mix = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mix = materialise(mix.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"), "test-order")
    assert len(mix.inputFiles()) > 4
    got = corpus_pipeline.pack_sequences(spark, mix, sf01).orderBy("sequence_id", "offset").collect()
    order = [r["doc_id"] for r in got]
    assert order == sorted(order) and set(order) == set(range(80))


def test_texts_reach_workers_in_small_batches(spark, sf01):
    """No stage hands a worker tens of MB of text at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 9000, 1, 1).selectExpr("id doc_id", "repeat('ab ', 1000) text", "'en' lang", "'s' source", "3000L n_chars")
    corpus_pipeline.drop_copies(spark, docs, sf01)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    assert max(r["n"] for r in docs.mapInArrow(sizes, "n bigint").collect()) < 4 << 20
