"""Canonical URL form (H6) and its hash (H7), as native column expressions.

The canonical form: trim; lower-case scheme, host, path, params and
fragment; the query decoded, lower-cased, grouped by key in order of first
appearance, sorted, and re-encoded with form encoding.  Everything runs in
higher-order array functions inside one row: no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic URI syntax with a scheme of letters, digits, + - . after a letter.
URL_RE = r"^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def form_decode(c: Column) -> Column:
    """Form decoding ('+' is a blank); text with a broken escape stays as is."""
    plus = F.regexp_replace(c, r"\+", " ")
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), plus)


def form_encode(c: Column) -> Column:
    """Form encoding with the unreserved set letters, digits and _ . - ~."""
    enc = F.url_encode(c)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(q: Column) -> Column:
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    kv = F.transform(pairs, lambda p: F.struct(
        form_decode(F.substring_index(p, "=", 1)).alias("k"),
        form_decode(F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p)))
                    .otherwise(F.lit(""))).alias("v")))
    return kv


# Schemes that take a '//' even with an empty host.
USES_NETLOC = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
               "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
               "git+ssh", "ws", "wss", "itms-services")


def normalize_url(url) -> Column:
    """H6: canonical form of a URL (see module doc)."""
    u = F.trim(_c(url))
    scheme = F.lower(F.regexp_extract(u, URL_RE, 2))
    host = F.lower(F.regexp_extract(u, URL_RE, 4))
    path = F.lower(F.regexp_extract(u, URL_RE, 5))
    # An empty ';' parameter after the last path segment disappears.
    path = F.regexp_replace(path, r"(^|/)([^/;]*);$", "$1$2")
    q = _encode_query(F.regexp_extract(u, URL_RE, 7))
    frag = F.lower(F.regexp_extract(u, URL_RE, 9))
    body = (F.when(host != "", F.concat(F.lit("//"), host,
                                        F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit("")),
                                        path))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when((scheme != "") & scheme.isin(*USES_NETLOC) & ((path == "") | path.startswith("/")),
                  F.concat(F.lit("//"), path))
            .otherwise(path))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )


def _encode_query(query: Column) -> Column:
    kv = canonical_query(query)
    raw_keys = F.array_distinct(F.transform(kv, lambda s: s["k"]))
    grouped = F.transform(raw_keys, lambda k: F.struct(
        F.lower(k).alias("k"),
        F.transform(F.filter(kv, lambda s: s["k"] == k), lambda s: F.lower(s["v"])).alias("vs")))
    ordered = F.array_sort(grouped)
    parts = F.flatten(F.transform(ordered, lambda g: F.transform(
        g["vs"], lambda v: F.concat(form_encode(g["k"]), F.lit("="), form_encode(v)))))
    return F.array_join(parts, "&")


def url_hash(normalized) -> Column:
    """H7: SHA-256 hex of the canonical URL."""
    return F.sha2(_c(normalized), 256)
