"""Dataset registry: upserts, deactivation of files that have gone, JSON
aggregates and distinct values.

The reference keeps the registry in PostgreSQL and updates it row by row.
Here the registry is a table of files; every change is a whole-table
relational step (union + per-key reduction, anti join), written as a new
version so that readers never see a half-written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.functions.core import dataset_key, json_long


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order_col: str | None = None,
           update_cols: list[str] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE, last writer wins.

    New rows beat existing rows; among several updates of one key the one
    with the greatest ``order_col`` wins.  The reduction is an aggregate
    (``max_by``), so map-side partial aggregation collapses repeated keys
    before the shuffle.  Columns outside ``update_cols`` keep their old value
    on conflict.
    """
    cols = existing.columns
    update_cols = [c for c in (update_cols or cols) if c not in keys]
    keep_cols = [c for c in cols if c not in keys and c not in update_cols]
    order = F.col(order_col) if order_col else F.lit(0)
    old = existing.select(*cols, F.lit(0).alias("_prio"), F.lit(None).cast("long").alias("_ord"))
    new = updates.select(*[F.col(c) if c in updates.columns else F.lit(None).alias(c) for c in cols],
                         F.lit(1).alias("_prio"), order.cast("long").alias("_ord"))
    both = old.unionByName(new)
    rank = F.struct(F.col("_prio"), F.coalesce(F.col("_ord"), F.lit(0)).alias("o"))
    agg = [F.max_by(F.struct(*update_cols), rank).alias("_win")]
    # Columns not updated come from the existing row when there is one.
    agg += [F.max_by(F.col(c), F.when(F.col("_prio") == 0, F.lit(1)).otherwise(F.lit(0))).alias(c) for c in keep_cols]
    out = both.groupBy(*keys).agg(*agg)
    return out.select(*[F.col(c) if c in keys or c in keep_cols else F.col("_win")[c].alias(c) for c in cols])


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING; returns the rows inserted: per
    key absent before, the row with the smallest ``order_col`` (without one,
    the smallest row by its columns from left to right)."""
    row = F.struct(*new.columns)
    first = F.min_by(row, F.col(order_col)) if order_col else F.min(row)
    firsts = new.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(first.alias("_r"))
    fresh = firsts.join(existing.select(F.col(key).alias("_key")), "_key", "left_anti").select("_r.*")
    nulls = new.where(F.col(key).isNull())      # NULL conflicts with nothing
    return fresh.unionByName(nulls)


def active_only(registry: DataFrame, name: str | None = None) -> DataFrame:
    """Rows with a validation document that are active (and named)."""
    cond = F.col("validation").isNotNull() & F.col("is_active")
    if name is not None:
        cond = cond & (F.col("name") == F.lit(name))
    return registry.where(cond)


def aggregate_by_name(registry: DataFrame, name: str | None = None, skip: int = 0,
                      limit: int | None = None) -> DataFrame:
    """Sums of ``file_size`` and ``row_count`` from the JSON document per
    name and period (null counts as 0), ordered; a page of ``limit`` groups
    only when the caller asks for one."""
    base = active_only(registry, name).select(
        "name", "period", json_long("validation", "file_size").alias("size"),
        json_long("validation", "row_count").alias("rows"))
    out = (base.groupBy("name", "period").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
           .orderBy(F.col("name").asc_nulls_last(), F.col("period").asc_nulls_last()))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out


def missing_files(registry: DataFrame, catalog: DataFrame, link_col: str = "link",
                  path_col: str = "path") -> DataFrame:
    """C4: active rows whose file is not in the catalog any more, returned as
    the changed rows (``is_active`` false).  One anti join over the whole
    table replaces the reference's keyset batches."""
    present = catalog.select(F.col(path_col).alias(link_col)).distinct()
    gone = registry.where(F.col("is_active")).join(present, link_col, "left_anti")
    return gone.withColumn("is_active", F.lit(False))


def apply_deactivation(registry: DataFrame, changed: DataFrame, key: str = "hash_sum") -> DataFrame:
    """The registry after C4: changed rows replace their old versions."""
    return upsert(registry, changed, [key], update_cols=["is_active"])


def update_registry(registry: DataFrame, changes: DataFrame, key: str = "hash_sum") -> DataFrame:
    """Partial update by key; a null in ``changes`` means "not supplied"
    and keeps the old value.  Rows without a change pass through."""
    fields = [c for c in changes.columns if c != key and c in registry.columns]
    ch = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = registry.join(ch, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                           for c in registry.columns])


def missing_counts(registry: DataFrame, catalog: DataFrame, link_col: str = "link", path_col: str = "path") -> DataFrame:
    """C4, the summary: active rows checked, files missing, rows updated."""
    present = catalog.select(F.col(path_col).alias(link_col)).distinct().withColumn("_present", F.lit(True))
    gone = F.col("is_active") & F.col("_present").isNull()
    return registry.join(present, link_col, "left").agg(
        F.count_if("is_active").alias("checked"), F.count_if(gone).alias("missing"), F.count_if(gone).alias("updated"))


def create_or_update(registry: DataFrame, changes: DataFrame, key: str = "hash_sum") -> DataFrame:
    """Rows whose key is known are updated as in ``update_registry``; the
    others are created, active unless they say otherwise.  Without a key the
    dataset key of name, period and link (H2) is taken."""
    keyed = changes.withColumn(key, F.coalesce(F.col(key), dataset_key("name", "period", "link")))
    updated = update_registry(registry, keyed, key)
    fresh = keyed.join(registry.select(key), key, "left_anti")
    cols = [F.col(c) if c in fresh.columns else F.lit(None).cast(registry.schema[c].dataType).alias(c) for c in registry.columns]
    fresh = fresh.select(*cols).withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    return updated.unionByName(fresh)


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values per field in one pass (null kept), as
    (field, value) rows with the value rendered as text.  Missing fields are
    skipped.  ``stack`` + ``distinct`` keeps every value set distributed;
    nothing is collected into one row."""
    fields = [f for f in fields if f in df.columns]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, value string")
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    return df.selectExpr(f"stack({len(fields)}, {pairs}) AS (field, value)").distinct()


def distinct_combinations(df: DataFrame, cols: list[str]) -> DataFrame:
    """SELECT DISTINCT over several columns, nulls kept."""
    return df.select(*cols).distinct()
