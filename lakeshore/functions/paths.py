"""Path helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeshore.functions.core import sanitize_name  # noqa: F401  (H8 lives with the other scalars)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def after_marker(path, marker: str = "source") -> Column:
    """H9: text after the first ``marker``, one leading slash removed; null
    when the marker is absent."""
    p = _c(path)
    pos = F.instr(p, marker)
    rest = p.substr(pos + F.lit(len(marker)), F.length(p) + 1)
    return F.when(pos > 0, F.regexp_replace(rest, r"^[\\/]", ""))


def relative_to(path, base: str) -> Column:
    """The path below ``base``; null when it is not inside."""
    b = base.rstrip("/")
    p = _c(path)
    return (F.when(p == F.lit(b), F.lit("."))
            .when(p.startswith(b + "/"), p.substr(len(b) + 2, 1 << 30)))


def join_path(base, *parts) -> Column:
    """Base / part / ... skipping null and blank parts."""
    arr = F.array(*[_c(x).cast("string") for x in (base, *parts)])
    kept = F.filter(arr, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.regexp_replace(F.array_join(kept, "/"), "/{2,}", "/")


def clean_path(p) -> Column:
    """Backslashes to slashes, empty parts dropped, no outer slashes."""
    c = F.regexp_replace(F.coalesce(_c(p), F.lit("")), r"\\", "/")
    return F.array_join(F.filter(F.split(c, "/"), lambda x: x != ""), "/")


def parent_path(p) -> Column:
    """All but the last part of a clean path ('' at the top)."""
    parts = F.split(_c(p), "/")
    return F.when((_c(p) == "") | (F.size(parts) <= 1), F.lit("")).otherwise(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def strip_suffix(name, ext: str, suffix: str = ".sended") -> Column:
    """H13 (name part): ``x.<ext><suffix>`` -> ``x.<ext>``, else null."""
    n = _c(name)
    tail = f".{ext}{suffix}"
    return F.when(n.endswith(tail), n.substr(F.lit(1), F.length(n) - len(suffix)))


def ancestors(path) -> Column:
    """All folders above a file path, outermost first."""
    parts = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))),
                       lambda i: F.array_join(F.slice(parts, 1, i), "/"))
