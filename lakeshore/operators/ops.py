"""Operational analytics: request memory statistics, snapshots, alerts,
logins, paging and previews (B1-B4, C7, D4, D7, D8, F1-F4, S10-S13 batch).

Sums of doubles go through DECIMAL so that the result does not depend on
the order in which partitions are combined (exact and repeatable at any
scale); everything else is plain aggregation with map-side partials.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.functions.core import alert_message, ram_level, ram_threshold, round_half_up
from lakeshore.operators.common import exact_sum

# Alert thresholds (MiB), snapshot interval (s), history (days),
# heavy request threshold (MiB), preview cap (rows).
RAM_WARNING_MB = 512
RAM_CRITICAL_MB = 1024
SNAPSHOT_INTERVAL_SEC = 60
HISTORY_RETENTION_DAYS = 7
HEAVY_DELTA_MB = 1.0
PREVIEW_MAX_ROWS = 1000
# Column names a preview filter may name (letters incl. Cyrillic, digits, _-. ()[] and blank).
FILTER_COLUMN_RE = r"^[a-zA-Zа-яА-ЯёЁ0-9_\-\. \(\)\[\]]+$"


def request_stats(requests: DataFrame) -> DataFrame:
    """Per app: peak of before/after RSS, number of requests, sum of
    positive deltas, and the RSS at the start of the latest request."""
    return requests.groupBy("app_name").agg(
        F.max(F.greatest("rss_before_mb", "rss_after_mb")).alias("peak_rss_mb"),
        F.count(F.lit(1)).alias("requests"),
        exact_sum(F.greatest(F.col("rss_delta_mb"), F.lit(0.0))).alias("total_delta_mb"),
        F.max_by("rss_before_mb", F.struct("captured_at", "id")).alias("current_rss_mb"))


def apps_report(stats: DataFrame, process_rss_mb: float) -> DataFrame:
    """Per app current, peak, requests, average delta per request (0
    without requests), share of the process RSS; plus the tracked total and
    the untracked rest on every row; ordered by peak.  The total is one
    scalar aggregate (a single number to the driver), used as a literal."""
    avg = F.when(F.col("requests") > 0, F.col("total_delta_mb") / F.col("requests")).otherwise(F.lit(0.0))
    pct = (F.col("current_rss_mb") / F.lit(process_rss_mb) * 100) if process_rss_mb > 0 else F.lit(0.0)
    tracked = stats.agg(F.sum("current_rss_mb")).first()[0] or 0.0
    out = stats.withColumn("_tracked", F.lit(float(tracked))).select(
        "app_name", "current_rss_mb", "peak_rss_mb", "requests",
        round_half_up(avg, 3).alias("avg_delta_per_request_mb"), round_half_up(pct, 2).alias("percent_of_total"),
        round_half_up(F.col("_tracked"), 2).alias("total_tracked_mb"),
        round_half_up(F.greatest(F.lit(0.0), F.lit(process_rss_mb) - F.col("_tracked")), 2).alias("untracked_mb"))
    return out.orderBy(F.col("peak_rss_mb").desc(), "app_name")


def snapshots(requests: DataFrame, interval_sec: int = SNAPSHOT_INTERVAL_SEC) -> DataFrame:
    """S10 (batch): per app and interval the requests in it and the peak so
    far (a running max over the intervals of the app)."""
    w = F.window("captured_at", f"{interval_sec} seconds")
    per = requests.groupBy("app_name", w.alias("w")).agg(
        F.count(F.lit(1)).alias("requests_count"),
        F.max(F.greatest("rss_before_mb", "rss_after_mb")).alias("_peak"),
        F.max_by("rss_before_mb", F.struct("captured_at", "id")).alias("rss_mb"))
    run = Window.partitionBy("app_name").orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("app_name", F.col("w.start").alias("captured_at"), "rss_mb", "requests_count",
                      F.max("_peak").over(run).alias("peak_rss_mb"))


def alerts(requests: DataFrame, warn: float = RAM_WARNING_MB, crit: float = RAM_CRITICAL_MB) -> DataFrame:
    """S11 (batch) / H21: one alert per request whose RSS after crosses a
    threshold."""
    lvl = ram_level(F.col("rss_after_mb"), warn, crit)
    thr = ram_threshold(F.col("rss_after_mb"), warn, crit)
    return requests.where(lvl.isNotNull()).select(
        "id", F.col("captured_at").alias("fired_at"), "app_name", lvl.alias("level"),
        F.col("rss_after_mb").alias("rss_mb"), thr.alias("threshold_mb"),
        alert_message(F.col("app_name"), F.col("rss_after_mb"), thr).alias("message"))


def since(df: DataFrame, ts_col: str, now, minutes: int, app: str | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``now`` (optionally one app)."""
    cond = F.col(ts_col) >= F.lit(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    if app is not None:
        cond = cond & (F.col("app_name") == app)
    return df.where(cond)


def retention(df: DataFrame, ts_col: str, now, days: int = HISTORY_RETENTION_DAYS) -> DataFrame:
    """The rows kept by the history cleanup (newer than now - days)."""
    return df.where(F.col(ts_col) >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def heavy_only(requests: DataFrame, min_delta_mb: float = HEAVY_DELTA_MB) -> DataFrame:
    """Requests worth persisting (delta of at least ``min_delta_mb``)."""
    return requests.where(F.col("rss_delta_mb") >= min_delta_mb)


def heavy_requests(requests: DataFrame, now, minutes: int, min_delta_mb: float, n: int) -> DataFrame:
    """top n requests by delta in the window (TakeOrderedAndProject)."""
    return (since(requests, "captured_at", now, minutes).where(F.col("rss_delta_mb") >= min_delta_mb)
            .orderBy(F.col("rss_delta_mb").desc(), F.col("id").asc()).limit(n))


def latest(df: DataFrame, ts_col: str, n: int, tie: str = "id") -> DataFrame:
    """newest n rows."""
    return df.orderBy(F.col(ts_col).desc(), F.col(tie).desc()).limit(n)


def login_summary(logins: DataFrame, user_id: int | None = None) -> DataFrame:
    """Per user attempts, successes, failures, last attempt, last success."""
    df = logins if user_id is None else logins.where(F.col("user_id") == user_id)
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.max("login_at").alias("last_attempt"),
        F.max(F.when(F.col("success"), F.col("login_at"))).alias("last_success"))


def optional_filters(df: DataFrame, **eq) -> DataFrame:
    """One equality predicate per supplied (non-None) parameter."""
    conds = [F.col(k) == F.lit(v) for k, v in eq.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """ORDER BY ... OFFSET skip LIMIT limit (order must end in a unique key)."""
    return df.orderBy(*order).offset(skip).limit(limit)


def page_meta(total: Column, page_no: int, size: int) -> Column:
    """struct(total_pages, has_next, has_prev) for a page of ``size``."""
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(size)))
    return F.struct(pages.cast("long").alias("total_pages"), (F.lit(page_no) < pages).alias("has_next"),
                    F.lit(page_no > 1).alias("has_prev"))


def _like_text(v: str) -> str:
    # Spark's LIKE treats a backslash as the escape character: double it so
    # it matches itself; % and _ in the value stay wildcards.
    return "%" + v.replace("\\", "\\\\") + "%"


def contains_filters(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """B1: AND of CAST(col AS STRING) ILIKE '%value%' for known columns with
    a safe name and a non-blank value."""
    import re
    conds = []
    for c, v in (filters or {}).items():
        if not v or c not in df.columns or not re.match(FILTER_COLUMN_RE, c):
            continue
        conds.append(F.col(f"`{c}`").cast("string").ilike(_like_text(v)))
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def preview(df: DataFrame, filters: dict[str, str], page_no: int, page_size: int, order: list[str],
            max_rows: int | None = None) -> tuple[DataFrame, dict]:
    """B2: filtered rows of one page plus meta.  With ``max_rows`` (a caller's
    cap, ``PREVIEW_MAX_ROWS`` for the web preview) counting stops at the cap."""
    f = contains_filters(df, filters)
    total = (f if max_rows is None else f.limit(max_rows)).count()
    offset = (page_no - 1) * page_size
    meta = {"total_rows": total, "page": page_no, "page_size": page_size,
            "has_next": offset + page_size < total, "total_pages": max(1, math.ceil(total / page_size))}
    if offset >= total:
        meta["message"] = f"page {page_no} out of range"
        return f.limit(0), meta
    return f.orderBy(*order).offset(offset).limit(page_size), meta


#: Registered prefixes that may be broadcast, and distinct lengths of them (one map-side join each).
BROADCAST_PREFIXES = 100_000
PREFIX_LENGTHS = 64


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path_col: str = "path", key: str = "id") -> DataFrame:
    """The app of the longest registered prefix (plain string prefix),
    else ``unknown``; of rows that repeat a prefix the smallest app.  The
    prefix table is configuration (one row per app), so its size is checked:
    up to ``BROADCAST_PREFIXES`` rows of at most ``PREFIX_LENGTHS`` lengths are
    joined map-side, once per length, longest first, and the paths stay where
    they are.  A larger table is joined by shuffling the paths' cuts; only
    there ``key``, a unique row key of ``paths``, is needed."""
    table = (prefixes.where(F.col("prefix").isNotNull()).groupBy("prefix")
             .agg(F.coalesce(F.min("app"), F.lit("unknown")).alias("app")))
    sizes = {r[0]: r[1] for r in table.groupBy(F.length("prefix")).count().collect()}
    if sum(sizes.values()) > BROADCAST_PREFIXES or len(sizes) > PREFIX_LENGTHS:
        return _longest_by_shuffle(paths, table, sorted(sizes), path_col, key)
    out, hits = paths, []
    for n in sorted(sizes, reverse=True):
        side = table.where(F.length("prefix") == n).select(F.col("prefix").alias(f"_prefix{n}"), F.col("app").alias(f"_app{n}"))
        cut = F.when(F.length(path_col) >= n, F.substring(path_col, 1, n))
        out, hits = out.join(F.broadcast(side), cut == F.col(f"_prefix{n}"), "left"), [*hits, F.col(f"_app{n}")]
    return out.select(*[F.col(f"`{c}`") for c in paths.columns], F.coalesce(*hits, F.lit("unknown")).alias("app"))


def _longest_by_shuffle(paths: DataFrame, table: DataFrame, lengths: list[int], path_col: str, key: str) -> DataFrame:
    cuts = (paths.select(key, path_col, F.explode(F.array(*[F.lit(n) for n in lengths])).alias("_len"))
            .where(F.length(path_col) >= F.col("_len"))
            .select(key, "_len", F.col(path_col).substr(F.lit(1), F.col("_len")).alias("prefix")))
    best = cuts.join(table, "prefix").groupBy(key).agg(F.max_by("app", F.col("_len")).alias("app"))
    return paths.join(best, key, "left").withColumn("app", F.coalesce("app", F.lit("unknown")))
