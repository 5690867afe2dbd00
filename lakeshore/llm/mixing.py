"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) have weights 5, 2, 1,
repeating, and share ``share`` times all words; no target may pass ``limit``
times its source's size, and the excess is shared again by weight.  That
fixed point is a water level, found from one sorted row per source.

Taking: a source's documents lie in a fixed pseudo-random order (MD5 of the
id) on a line of its words, repeated ``limit`` times; what lies below the
target is taken, so a source's taken words equal its rounded target, at most
one document per source is taken in part, and none more than ``limit`` times.

Positions: each source has a weight schedule over training time 0..1
(piecewise linear, mean 1).  Its integral is the source's cumulative token
demand; inverting that at the place where an occurrence begins gives the
occurrence's training position.  The mix is range-sorted by position.

Defined cases: null text has no words; a source without words has target 0; a
null source is a source of its own, the last one; rows that repeat an id are
laid out one after another (longer first); an empty table gives an empty mix.
The prefix sums run per (source, MD5 prefix) bucket, so a source that holds a
third of all rows is spread over ``BUCKETS`` buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import WORD, materialise, text_key, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: MD5 digits that name a bucket of a source's line: 16 ** 3 buckets.
BUCKET_DIGITS = 3
#: Weight schedules by rank of the source, repeating: (time, relative weight) knots.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.6), (0.5, 0.8), (1.0, 0.8)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   limit: int = LIMIT) -> DataFrame:
    """From (source, size) rows: ``source``, ``source_size``, ``rank``, ``target``.
    The work is one row per source, far below the documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * limit).withColumn("level", F.col("cap") / F.col("weight"))
    # With sources sorted by the level at which they fill up: those before a
    # row are full, the rest share what is left; the water level is the first
    # share that does not pass the row's own level.
    before = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * share
    full = F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("trial", (total - full) / heavy)
    per = per.withColumn("water", F.min(F.when(F.col("trial") <= F.col("level"), F.struct("level", "rank", "trial")))
                         .over(every)["trial"])
    target = F.when(F.col("level") <= F.col("water"), F.col("cap").cast("double")).otherwise(
        F.col("water") * F.col("weight"))
    return per.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def invert_schedule(knots: tuple[tuple[float, float], ...], demand: Column) -> Column:
    """Time at which the integral of a piecewise-linear weight schedule,
    scaled to 1 over all time, reaches ``demand`` (0..1)."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = math.fsum(area), 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t0, w0), (t1, w1), part in zip(knots, knots[1:], area):
        x = F.greatest(demand * whole - done, F.lit(0.0))     # area still to cover in this piece
        slope = (w1 - w0) / (t1 - t0)
        # w0 * u + slope * u^2 / 2 = x, in the form that is stable for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * x, F.lit(0.0)))
        pieces.append((done + part, t0 + 2 * x / F.greatest(root + w0, F.lit(1e-300))))
        done += part
    for end, time in reversed(pieces):
        out = F.when(demand * whole <= end, F.least(time, F.lit(knots[-1][0]))).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
        schedules=SCHEDULES) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key``, ``source``, ``size``,
    ``source_size``, ``target``, ``taken`` and ``occurrences``, an array of
    (``position``, ``words``) in the mix."""
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), order.alias("order")), "sizes")
    targets = materialise(source_targets(rows.select("source", "size"), weights, share, limit), "targets")
    bucket = F.substring("order", 1, BUCKET_DIGITS).alias("bucket")
    buckets = rows.groupBy("source", bucket).agg(F.sum("size").alias("bucket_size"))
    line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(line), F.lit(0)))
    buckets = buckets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("bs"), F.col("bucket").alias("bb"), "bucket_start", "source_size", "target", "rank")
    inside = Window.partitionBy("source", "bucket").orderBy("order", F.col("id").asc_nulls_last(), F.desc("size"),
                                                            "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
    start = F.col("bucket_start") + F.col("inside")
    whole = F.round("target").cast("long")
    rows = rows.withColumn("start", start).withColumn("whole", whole)

    def occurrence(lap: int) -> Column:
        begin = F.col("start") + lap * F.col("source_size")
        words = F.greatest(F.least(F.col("whole") - begin, F.col("size")), F.lit(0)).cast("long")
        demand = begin / F.col("whole")
        position = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            position = F.when(F.col("rank") % len(schedules) == i, invert_schedule(knots, demand)).otherwise(position)
        return F.struct(position.alias("position"), words.alias("words"))

    laps = F.filter(F.array(*[occurrence(i) for i in range(limit)]), lambda o: o["words"] > 0)
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, o: n + o["words"])
    return rows.withColumn("occurrences", laps).select(
        "id", "key", "source", "size", "source_size", "target", taken.alias("taken"), "occurrences", "order")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, once per occurrence
    and range-sorted by training position; the occurrence that its source's
    target cuts holds the words up to the cut.  Documents outside the mix,
    documents without words among them, do not appear."""
    names = {"id": "pid", "key": "pkey", "source": "psource"}
    plan = materialise(mix(docs, id_col, text_col, source_col, **options).withColumnsRenamed(names), "mix")
    # Id, text and source as one key; equal structs agree in nulls too.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(
        text_key(F.col(text_col)).alias("pkey"), F.col(id_col).alias("pid"), F.col(source_col).alias("psource")).alias("at"),
        F.monotonically_increasing_id().alias("number"))
    places = plan.groupBy(F.struct("pkey", "pid", "psource").alias("place")).agg(
        F.first("size").alias("size"), F.flatten(F.collect_list("occurrences")).alias("occurrences"))
    # Rows that agree in id, text and source have several places each: one row
    # of them stands for all, so that every place is filled once.  The window
    # has the join's order, so texts are shuffled once before the final sort.
    placed = rows.join(places, F.col("at") == F.col("place"))
    placed = placed.withColumn("first", F.min("number").over(Window.partitionBy("place")))
    placed = placed.filter(F.col("number") == F.col("first"))
    mixed = placed.select("row", F.col("place.pid").alias("id"), F.col("place.pkey").alias("key"), "size",
                          F.explode("occurrences").alias("o")).select("*", "o.*")
    cut = F.when(F.col("words") < F.col("size"), first_words(F.col(f"row.`{text_col}`"), F.col("words"))).otherwise(
        F.col(f"row.`{text_col}`"))
    mixed = mixed.withColumn("row", F.col("row").withField(f"`{text_col}`", cut))
    return mixed.orderBy("position", "id", "key").select("row.*")
