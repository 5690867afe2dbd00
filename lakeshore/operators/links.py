"""Link registry: canonical URLs, existence checks, new/duplicate status.

A hot URL (one link repeated in a third of the input) must not pin a third
of the rows to one task.  Rows are reduced to one per hash (combined
map-side), that table is joined with the known hashes, and the verdicts go
back to the rows by a hash salted with the row: the one row per hash is
repeated ``SALT`` times, the raw rows spread over the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.functions.urls import normalize_url, url_hash
from lakeshore.operators.common import spread_for_cpu


def prepare_urls(candidates: DataFrame, url_col: str = "url") -> DataFrame:
    """(original, normalized, hash) per input row."""
    norm = normalize_url(F.col(url_col))
    # A non-nullable hash (a null URL gets a marker no SHA-256 hex can equal):
    # with a nullable one Catalyst infers isnotnull(sha2(<canonical form>))
    # from the joins and evaluates the whole canonicalisation again at the scan.
    h = F.coalesce(url_hash(F.col("url_normalized")), F.lit("<null url>"))
    return spread_for_cpu(candidates).withColumn("url_normalized", norm).withColumn("url_hash", h)


#: Copies of the one-row-per-hash table when its verdicts go back to the rows.
SALT = 16


def _give_back(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``verdicts`` (one row per ``url_hash``)."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(F.struct(*[c for c in rows.columns if c != "url_hash"])), F.lit(SALT)))
    copies = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return spread.join(copies, ["url_hash", "_salt"]).drop("_salt")


def _known(links: DataFrame) -> DataFrame:
    if "url_hash" in links.columns:
        return links.select("url_hash").distinct()
    return links.select(url_hash(F.col("url_normalized")).alias("url_hash")).distinct()


def _order(order_col: str, url_col: str) -> Column:
    """Which row of a hash is the first: by id, rows without one last."""
    return F.struct(F.col(order_col).isNull(), F.col(order_col), F.col(url_col).isNull(), F.col(url_col))


def links_exist(candidates: DataFrame, links: DataFrame, url_col: str = "url") -> DataFrame:
    """One flag per input row (duplicates kept)."""
    prepared = prepare_urls(candidates, url_col)
    known = _known(links).withColumn("_hit", F.lit(True))
    hashes = prepared.select("url_hash").distinct().join(known, "url_hash", "left")
    return _give_back(prepared, hashes.select("url_hash", F.coalesce("_hit", F.lit(False)).alias("exists")))


def new_links(candidates: DataFrame, links: DataFrame, url_col: str = "url", order_col: str = "id",
              compat: bool = False) -> DataFrame:
    """Status ``new`` for the first row of each hash not yet in the
    table, ``duplicate`` otherwise (rows that share the first id or have none
    too, and its URL, are all ``new``).  ``compat=True`` marks every row of an
    unknown hash ``new`` (the reference's behaviour within one batch)."""
    prepared = prepare_urls(candidates, url_col)
    known = _known(links).withColumn("_known", F.lit(True))
    firsts = prepared.groupBy("url_hash").agg(F.min(_order(order_col, url_col)).alias("_first"))
    out = _give_back(prepared, firsts.join(known, "url_hash", "left"))
    is_new = F.col("_known").isNull() & (F.lit(compat) | _order(order_col, url_col).eqNullSafe(F.col("_first")))
    return (out.withColumn("status", F.when(is_new, F.lit("new")).otherwise(F.lit("duplicate")))
            .drop("_known", "_first"))


def link_status_counts(statuses: DataFrame) -> DataFrame:
    """Number of rows per status."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def insert_new(candidates: DataFrame, links: DataFrame, url_col: str = "url", order_col: str = "id") -> DataFrame:
    """A12 on links: rows to insert (first per hash, hash not present)."""
    prepared = prepare_urls(candidates, url_col)
    firsts = prepared.groupBy("url_hash").agg(
        F.min_by(F.struct(F.col(order_col), F.col(url_col), F.col("url_normalized")), _order(order_col, url_col)).alias("r"))
    fresh = firsts.join(_known(links), "url_hash", "left_anti")
    return fresh.select(F.col("r")[order_col].alias(order_col), F.col("r")[url_col].alias(url_col),
                        F.col("r.url_normalized").alias("url_normalized"), "url_hash")


def in_set(df: DataFrame, col: str, values) -> DataFrame:
    """``col IN (...)``: a literal list becomes ``isin``; a DataFrame of
    values becomes a semi join (Catalyst broadcasts it when it is small)."""
    if isinstance(values, DataFrame):
        vals = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(vals, col, "left_semi")
    return df.where(F.col(col).isin(list(values)))
