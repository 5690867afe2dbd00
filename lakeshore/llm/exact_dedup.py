"""Exact deduplication with a heavy-hitter split.

Texts are equal when they agree after deleting ASCII white space.  Each text
becomes a SHA-256 digest, and all later work is on (digest, length, id) rows.
A Misra-Gries summary (Spark's mergeable frequent-items sketch) names the
digests that may be frequent; their exact winners are verified by one
aggregation and broadcast (at most ``MAX_HOT`` rows), so the rows of hot
groups are decided map-side.  All other digests take an ordinary shuffle.

Defined cases: null text counts as empty, so all empty and null texts are one
group; a null id comes after every other id; of rows that agree in text
length and id one stays (the first in scan order); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import keep_rows, materialise, text_key, text_or_empty, without_space

#: Digests that the summary may name, hence rows of the broadcast (about 150 bytes each).
MAX_HOT = 1024
#: Counters of one summary; a digest with more than rows / TRACKED rows is always found.
TRACKED = 4096
#: Summaries are merged in this many groups first, then in one.
MERGE_GROUPS = 64


def frequent_items(df: DataFrame, column: str, k: int = MAX_HOT, tracked: int = TRACKED) -> DataFrame:
    """Candidates for the frequent values of ``column`` (one column ``item``,
    at most ``k`` rows) from a Misra-Gries summary that is merged in two
    levels, so no task receives the summaries of all input partitions."""
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("summary"))
    # Grouped by a constant: an ungrouped merge fails on input partitions without rows.
    top = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {tracked}), {k})").alias("top"))
    return top.select(F.inline("top")).filter("count > 1").select("item")


def _winner() -> Column:
    """Most code points first, then the smallest id, nulls last, then scan order."""
    return F.min(F.struct((-F.col("chars")).alias("neg_chars"), F.col("id").isNull().alias("no_id"), "id", "rid"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_hot: int = MAX_HOT) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key`` (see ``text_key``),
    ``digest`` (lowercase hex), ``keep_id``, ``group_size``, ``kept``."""
    text = text_or_empty(F.col(text_col))
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), text_key(text).alias("key"), F.length(text).cast("long").alias("chars"),
        F.sha2(without_space(text), 256).alias("digest"), F.monotonically_increasing_id().alias("rid")), "digests")
    groups = [F.count(F.lit(1)).alias("group_size"), _winner().alias("winner")]
    candidates = F.broadcast(frequent_items(rows, "digest", max_hot).withColumnRenamed("item", "digest"))
    hot = materialise(rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(*groups), "hot-winners")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    decided = rows.join(F.broadcast(hot), "digest").unionByName(
        rest.join(rest.groupBy("digest").agg(*groups), "digest"))
    return decided.select("id", "key", "digest", F.col("winner.id").alias("keep_id"), "group_size",
                          (F.col("rid") == F.col("winner.rid")).alias("kept"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = materialise(duplicate_groups(docs, id_col, text_col), "exact-groups")
    kept = decided.filter("kept").select("id", "key")
    copies = decided.filter("group_size > 1").groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies"))
    c = copies.filter("copies > 1").select(F.col("id").alias("cid"), F.col("key").alias("ckey"), "copies")
    kept = kept.join(c, (F.col("key") == F.col("ckey")) & F.col("id").eqNullSafe(F.col("cid")), "left").select(
        "id", "key", F.coalesce("copies", F.lit(1)).alias("n"))
    return keep_rows(docs, kept, id_col, text_col)
