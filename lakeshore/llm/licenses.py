"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and templates are words (runs of letters and digits, lower case) and
shingles of ``SHINGLE`` words, each a 64-bit hash.  Templates are grouped by
length class, the power of two that holds their words.  For class c a text is
cut into windows of 2c words at every c words, so a passage of up to c words
lies whole in a window.  Each band is one MinHash value.  A window that holds
``CONTAINMENT`` of a template's m shingles has Jaccard similarity of at least
J = 0.8 m / (2c - 4 + 0.2 m) with it; a class has so many bands that a
collision is missed with probability below ``MISS`` even for its shortest
template.  Retrieved pairs are verified by exact containment of the shingle
sets.  A band can only agree when the template's smallest shingle is in the
window, so windows that hold no template shingle at all are left out before
their MinHash values are computed; nothing else is.  The template table is
bounded: it is the fixed list or the caller's, up to ``TEMPLATES`` rows.

All of it is DataFrame functions; documents are not shuffled, only the few
windows that hold template shingles are.

Defined cases: null and empty texts, and texts under ``SHINGLE`` words, hold
no license; templates under ``SHINGLE`` words are refused; null ids and repeated
rows are reported like others, one row per (document row, template, place);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import materialise, text_or_empty
from lakeshore.llm.license_texts import TEMPLATES as LICENSES

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
SMALLEST_CLASS = 8
#: Templates of one scan, at most; their bands are broadcast (under 200 rows of 24 bytes each).
TEMPLATES = 256
WORDS = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def shingle_hashes(words_: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles in order; empty for fewer words."""
    # Single items, not slices: a slice inside a lambda copies the whole array.
    every = F.transform(F.sequence(F.lit(0), F.size(words_) - size),
                        lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(size)]))
    return F.when(F.size(words_) >= size, every).otherwise(F.array().cast("array<bigint>"))


def _array(hashes: set[int]) -> Column:
    """A literal array of longs, parsed at once (one literal each is slow to build)."""
    return F.expr("array(" + ", ".join(f"bigint('{h}')" for h in sorted(hashes)) + ")")


def bands(class_: int, shingles: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that a class needs for templates of at least ``shingles`` shingles."""
    window = 2 * class_ - SHINGLE + 1
    jaccard = min(0.999, containment * shingles / (window + (1 - containment) * shingles))
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def _band(k: Column, hashes: Column) -> Column:
    """MinHash value ``k`` of a set of hashes."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Name, class, and shingle hashes of each template (a bounded list)."""
    if len(templates) > TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {TEMPLATES}")
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("words"))
    rows = rows.select("name", F.size("words").alias("n"), F.array_distinct(shingle_hashes(F.col("words"))).alias("shingles"))
    out = []
    for r in rows.collect():
        if not r["shingles"]:
            raise ValueError(f"template {r['name']} has fewer than {SHINGLE} words")
        out.append({"name": r["name"], "class": max(SMALLEST_CLASS, 1 << (r["n"] - 1).bit_length()), "shingles": r["shingles"]})
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per license passage: ``id``, ``license``, ``containment``,
    ``start`` and ``end`` (code points, end exclusive) and ``passage``."""
    spark = docs.sparkSession
    table = template_table(spark, LICENSES if templates is None else templates)
    every = _array({h for t in table for h in t["shingles"]})
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    # One expression under an outer explode: a filter on the hashes would be
    # pushed below and compute them, and the words, again for each use.
    hashes = F.transform(F.array(words(F.col("text"))), lambda w: shingle_hashes(w))
    rows = rows.select("rid", "id", "text", F.explode_outer(
        F.filter(hashes, lambda h: F.arrays_overlap(h, every))).alias("shingles")).filter("shingles is not null")
    rows = materialise(rows, "license-texts")
    classes = sorted({t["class"] for t in table})
    parts = []
    for c in classes:
        mine = [t for t in table if t["class"] == c]
        some = _array({h for t in mine for h in t["shingles"]})
        number = bands(c, min(len(t["shingles"]) for t in mine), containment)
        # Windows that hold a template shingle, from the places of these.  Each
        # shingle is looked up among the text's few template shingles only.
        places = F.get(F.transform(F.array(F.array_intersect("shingles", some)), lambda few: F.filter(
            F.transform("shingles", lambda h, i: F.when(F.array_contains(few, h), F.floor(i / c))),
            lambda i: i.isNotNull())), F.lit(0))
        numbers = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, F.greatest(i - 1, F.lit(0))))))
        windows = F.transform(numbers, lambda i: F.struct((i * c).cast("int").alias("first"), F.slice(
            "shingles", (i * c + 1).cast("int"), 2 * c - SHINGLE + 1).alias("inside")))
        windows = F.filter(windows, lambda w: F.arrays_overlap(w["inside"], some))
        windows = F.transform(windows, lambda w: F.struct(w["first"].alias("first"), w["inside"].alias("inside"), F.transform(
            F.sequence(F.lit(1), F.lit(number)), lambda k: F.struct(
                k.alias("band"), _band(k, w["inside"]).alias("value"))).alias("bands")))
        windows = rows.select("rid", F.lit(c).alias("class"), F.explode_outer(windows).alias("w")).filter(
            "w is not null").select("rid", "class", "w.*")
        parts.append(windows)
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = materialise(windows, "license-windows")
    known = spark.createDataFrame([(i, t["name"], t["class"], t["shingles"]) for i, t in enumerate(table)],
                                  "template int, license string, class int, wanted array<bigint>")
    most = {c: bands(c, min(len(t["shingles"]) for t in table if t["class"] == c), containment) for c in classes}
    number = F.element_at(F.create_map(*[F.lit(x) for item in most.items() for x in item]), F.col("class"))
    marks = known.select("template", "class", "wanted", F.explode(F.sequence(F.lit(1), number)).alias("band")).select(
        "template", F.col("class").alias("c"), F.col("band").alias("b"), _band(F.col("band"), F.col("wanted")).alias("v"))
    drawn = windows.select("rid", "class", "first", F.inline("bands")).join(
        F.broadcast(marks), (F.col("class") == F.col("c")) & (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")))
    pairs = drawn.select("rid", "class", "first", "template").distinct()
    checked = pairs.join(windows.select("rid", "class", "first", "inside"), ["rid", "class", "first"]).join(
        F.broadcast(known.drop("class")), "template")
    hits = F.filter(F.transform("inside", lambda h, i: F.when(F.array_contains("wanted", h), i)), lambda i: i.isNotNull())
    share = F.size(F.array_intersect("inside", "wanted")) / F.size("wanted")
    checked = checked.withColumn("containment", share).filter(F.col("containment") >= containment).select(
        "rid", "license", "containment", (F.col("first") + F.array_min(hits)).alias("from"),
        (F.col("first") + F.array_max(hits) + SHINGLE - 1).alias("to"))
    # Overlapping windows see one passage from the same first word, or only a
    # part of it; a part beside a fuller view is not a passage of its own.
    place = checked.groupBy("rid", "license", "from").agg(F.max(F.struct("containment", "to")).alias("best"))
    row = Window.partitionBy("rid", "license").orderBy("from")
    before, after = F.lag(F.struct("from", "best")).over(row), F.lead(F.struct("from", "best")).over(row)
    less = F.coalesce((before["best"]["to"] > F.col("from")) & (before["best"]["containment"] > F.col("best.containment")), F.lit(False))
    less = less | F.coalesce((after["from"] < F.col("best.to")) & (after["best"]["containment"] > F.col("best.containment")), F.lit(False))
    place = place.withColumn("less", less).filter("not less")
    found = rows.join(place, "rid").withColumn("gaps", F.split("text", WORDS, -1)).withColumn(
        "runs", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))

    def reach(number: Column) -> Column:
        """Code points before word ``number`` (from 0): its gaps and the words before it."""
        return (F.length(F.array_join(F.slice("gaps", F.lit(1), (number + 1).cast("int")), ""))
                + F.length(F.array_join(F.slice("runs", F.lit(1), number.cast("int")), ""))).cast("long")

    found = found.withColumn("begin", reach(F.col("from"))).withColumn(
        "stop", reach(F.col("best.to")) + F.length(F.get("runs", F.col("best.to").cast("int"))))
    start, end = F.col("begin"), F.col("stop")
    return found.select("id", "license", F.col("best.containment").alias("containment"), start.alias("start"), end.alias("end"),
                        F.substr(F.col("text"), (start + 1).cast("int"), (end - start).cast("int")).alias("passage"))
