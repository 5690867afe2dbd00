import random
import re

import pytest

from lakeshore.llm import licenses
from lakeshore.llm.license_texts import TEMPLATES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws):
    return [" ".join(ws[i:i + 5]) for i in range(len(ws) - 4)]


def best(text, template):
    """Highest containment of the template in any run as long as its class."""
    ws, want = words(text), set(shingles(words(template)))
    c = max(8, 1 << (len(words(template)) - 1).bit_length())
    every = shingles(ws)
    return max((len(want & set(every[i:i + 2 * c - 4])) / len(want) for i in range(0, max(1, len(every)), c)), default=0)


def test_planted_licenses(spark, clash, odd):
    rnd = random.Random(6)
    filler = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = []
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        rows.append((len(rows), f"{filler(i * 37)}. {text} {filler(20)}"))
        rows.append((len(rows), text.upper().replace(" ", "\n  ")))
        ws = text.split()
        if len(ws) > 40:
            rows.append((len(rows), filler(5000) + " " + " ".join(ws[:3] + ["changed"] + ws[4:]) + " " + filler(9)))
            rows.append((len(rows), " ".join(ws[: len(ws) // 2])))
        rows.append((len(rows), f"{text} {filler(300)} {text}"))
    rows += [(1000, filler(400)), (1001, "license"), (1002, None), (1003, ""), (None, "Released under the MIT License.")]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    got = licenses.scan(df).collect()
    found = {(r["id"], r["license"]) for r in got}
    want = {(i, n) for i, t in rows for n, x in TEMPLATES.items() if t and best(t, x) >= 0.8}
    assert found == want
    text = dict(rows)
    for r in got:
        passage = text[r["id"]][r["start"]:r["end"]]
        assert passage == r["passage"]
        assert best(passage, TEMPLATES[r["license"]]) == pytest.approx(r["containment"])
    assert licenses.scan(odd).count() == 0


def test_whole_table(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = {(r["id"], r["license"]) for r in licenses.scan(docs).collect()}
    want = {(d["doc_id"], n) for d in docs.collect() for n, x in TEMPLATES.items()
            if set(shingles(words(d["text"]))) & set(shingles(words(x))) and best(d["text"], x) >= 0.8}
    assert got == want and want


def test_band_counts_bound_the_misses():
    for c, m in ((8, 1), (16, 5), (64, 29)):
        j = 0.8 * m / (2 * c - 4 + 0.2 * m)
        assert (1 - j) ** licenses.bands(c, m) <= licenses.MISS


def test_refused_templates_and_empty(spark, empty):
    with pytest.raises(ValueError):
        licenses.scan(empty, {"short": "two words"})
    assert licenses.scan(empty).count() == 0
