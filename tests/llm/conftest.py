import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use inside.
CLASHING = ["id", "key", "digest", "kept", "row", "rid", "group", "component", "fp", "size", "taken", "words", "block",
            "position", "score", "spans", "start", "n", "perplexity", "shingles", "y", "lid"]


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeats."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 60))) + "." for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", None, ""]), len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n\x0b\f\r", "en", "s1", 6),
             (None, "null id", "en", "s1", 7), (None, "null id", "en", "s1", 7), (None, None, None, None, None),
             (103, texts[0] + " ", "en", "s2", 1), (104, texts[0].replace(" ", "\n"), "fr", "s2", 2),
             (105, "x" * 50_000, "en", "s1", 50_000), (106, "a b c. " * 20_000, "en", "s1", 140_000),
             (7, texts[7], "en", "s1", 1), (7, texts[7], "en", "s1", 1), (7, texts[8], "en", "s1", 1),
             (107, "Ünï \x1c\x85\xa0 İstanbul 😀 á ΑΣ.", "xx", "é", 9)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
    return add
