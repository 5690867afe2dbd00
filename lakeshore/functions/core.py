"""Scalar column functions.  Each returns a Column built from Spark's
built-in expressions, so everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PART = r"^\d{4}-\d{2}-\d{2}$"
PERIOD_PART = r"^(\d{4}|\d{6}|\d{8})$"
# ISO 8601 date-time layouts accepted after a plain date failed (H4); tried in order.
ISO_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyyMMdd",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_as_none(c) -> Column:
    """Render a value the way Python's str() does inside an f-string."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def dataset_key(name, period, link) -> Column:
    """H2: SHA-256 of ``name:period:link`` (a missing part prints as None)."""
    return F.sha2(F.concat_ws(":", null_as_none(name), null_as_none(period), null_as_none(link)), 256)


def path_parts(path) -> Column:
    """Parts of a path as ``pathlib`` sees them (root '/' first, no empties)."""
    p = _c(path)
    rest = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), rest)).otherwise(rest)


def path_metadata(path) -> Column:
    """H3: struct(source, period, date) from the first ``YYYY-MM-DD`` part.
    The part before is the source, the part after the period when it has
    4, 6 or 8 digits; an impossible date gives a null date only."""
    parts = path_parts(path)
    idx = F.array_position(F.transform(parts, lambda x: x.rlike(DATE_PART)), F.lit(True))
    found = idx > 0
    date_part = F.try_element_at(parts, F.when(found, idx).otherwise(F.lit(1)).cast("int"))
    source = F.when(found & (idx > 1), F.try_element_at(parts, (idx - 1).cast("int")))
    nxt = F.when(found & (idx < F.size(parts)), F.try_element_at(parts, (idx + 1).cast("int")))
    period = F.when(nxt.rlike(PERIOD_PART), nxt)
    date = F.when(found, F.try_to_date(date_part, "yyyy-MM-dd"))
    return F.struct(source.alias("source"), period.alias("period"), date.alias("date"))


def parse_date(text) -> Column:
    """H4: ``YYYY-MM-DD``, else an ISO date-time reduced to its date, else null.
    ``try_cast`` is not used: it would read ``2024`` as 2024-01-01."""
    t = F.trim(_c(text))
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    iso = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ISO_FORMATS])
    return F.coalesce(plain, F.to_date(iso))


def json_long(col, field: str) -> Column:
    """H5: a JSON field as bigint, 0 when absent, null or not a number."""
    return F.coalesce(F.get_json_object(_c(col), f"$.{field}").try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_period(v) -> Column:
    """Value as trimmed text, blank becomes null."""
    return F.nullif(F.trim(_c(v).cast("string")), F.lit(""))


def to_mb(b) -> Column:
    """Bytes to MiB, two decimals (half away from zero)."""
    return F.floor(_c(b) / F.lit(1024.0 * 1024.0) * 100 + 0.5) / 100


def to_gb(b) -> Column:
    return F.floor(_c(b) / F.lit(1024.0 ** 3) * 100 + 0.5) / 100


def round_half_up(x, digits: int = 2) -> Column:
    """Rounding that both Spark and DuckDB compute identically on doubles."""
    scale = 10 ** digits
    return F.floor(_c(x) * scale + 0.5) / scale


def sanitize_name(v) -> Column:
    """H8: characters not allowed in file names become ``_``."""
    return F.translate(_c(v).cast("string"), '/\\:*?"<>|', "_________")


def client_ip(forwarded, host) -> Column:
    """First X-Forwarded-For entry, else the peer host, else unknown."""
    first = F.nullif(F.trim(F.split(_c(forwarded), ",").getItem(0)), F.lit(""))
    return F.coalesce(first, _c(host), F.lit("unknown"))


def body_preview(text, n: int = 500) -> Column:
    """First n characters."""
    return F.substring(_c(text), 1, n)


def mask_middle(v, n: int = 4) -> Column:
    """Keep n/2 characters at each end and star the rest; values of at
    most 2n characters are starred whole; null or empty prints as None."""
    s = _c(v).cast("string")
    half = n // 2
    ln = F.length(s)
    masked = F.concat(F.substring(s, 1, half), F.repeat(F.lit("*"), ln - n), F.substring(s, ln - half + 1, half))
    return (F.when(s.isNull() | (s == ""), F.lit("None"))
            .when(ln <= 2 * n, F.repeat(F.lit("*"), ln))
            .otherwise(masked))


def ram_level(mb, warn: float = 512.0, crit: float = 1024.0) -> Column:
    """CRITICAL at or above crit MiB, WARNING at or above warn, else null."""
    m = _c(mb)
    return F.when(m >= crit, F.lit("CRITICAL")).when(m >= warn, F.lit("WARNING"))


def alert_message(app, mb, threshold) -> Column:
    """Alert text: App '<app>' consumed <mb, one decimal> MB (threshold <t> MB)."""
    return F.format_string("App '%s' consumed %.1f MB (threshold %d MB)", _c(app), round_half_up(mb, 1),
                           _c(threshold).cast("int"))


def ram_threshold(mb, warn: float = 512.0, crit: float = 1024.0) -> Column:
    m = _c(mb)
    return F.when(m >= crit, F.lit(float(crit))).when(m >= warn, F.lit(float(warn)))
