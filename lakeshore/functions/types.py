"""Type names across dialects: normalisation (H14) and compatibility.

The dialect maps and the compatibility matrix are literal map columns, so a
lookup is a map access inside generated code: no join, no UDF.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dialect type name -> canonical name.
TYPE_MAPPING = {
    "parquet": {
        "int32": "INTEGER", "int64": "BIGINT", "float": "REAL", "double": "DOUBLE PRECISION",
        "string": "VARCHAR", "boolean": "BOOLEAN", "date32": "DATE", "date64": "DATE",
        "timestamp": "TIMESTAMP", "timestamp[us, tz=utc]": "TIMESTAMPTZ", "timestamp[ms]": "TIMESTAMP",
        "timestamp[us]": "TIMESTAMP", "timestamp[ns]": "TIMESTAMP",
    },
    "postgresql": {
        "integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "real": "REAL",
        "double precision": "DOUBLE PRECISION", "numeric": "DECIMAL", "decimal": "DECIMAL",
        "varchar": "VARCHAR", "character varying": "VARCHAR", "text": "TEXT", "boolean": "BOOLEAN",
        "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP", "timestamp with time zone": "TIMESTAMPTZ",
        "timestamptz": "TIMESTAMPTZ", "json": "JSON", "jsonb": "JSON", "uuid": "UUID", "bytea": "BYTEA",
    },
    "duckdb": {
        "integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "float": "REAL",
        "double": "DOUBLE PRECISION", "decimal": "DECIMAL", "varchar": "VARCHAR", "text": "TEXT",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp with time zone": "TIMESTAMPTZ",
        "json": "JSON",
    },
    "mysql": {
        "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "float": "REAL", "double": "DOUBLE PRECISION",
        "decimal": "DECIMAL", "varchar": "VARCHAR", "text": "TEXT", "boolean": "BOOLEAN", "date": "DATE",
        "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "json": "JSON",
    },
}

# Canonical source type -> target types it may be loaded into.
COMPATIBLE_TYPES = {
    "INTEGER": ["INTEGER", "BIGINT", "SMALLINT", "REAL", "DOUBLE PRECISION", "DECIMAL", "TEXT"],
    "BIGINT": ["BIGINT", "INTEGER", "REAL", "DOUBLE PRECISION", "DECIMAL", "TEXT"],
    "SMALLINT": ["SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "DECIMAL", "TEXT"],
    "REAL": ["REAL", "DOUBLE PRECISION", "DECIMAL", "TEXT"],
    "DOUBLE PRECISION": ["DOUBLE PRECISION", "REAL", "DECIMAL", "TEXT"],
    "DECIMAL": ["DECIMAL", "REAL", "DOUBLE PRECISION", "TEXT"],
    "VARCHAR": ["VARCHAR", "TEXT", "CHAR"],
    "TEXT": ["TEXT", "VARCHAR"],
    "BOOLEAN": ["BOOLEAN", "INTEGER", "SMALLINT"],
    "DATE": ["DATE", "TIMESTAMP", "TEXT"],
    "TIME": ["TIME", "TIMESTAMP", "TEXT"],
    "TIMESTAMP": ["TIMESTAMP", "TIMESTAMPTZ", "DATETIME", "TEXT"],
    "TIMESTAMPTZ": ["TIMESTAMPTZ", "TIMESTAMP", "DATETIME", "TEXT"],
    "JSON": ["JSON", "JSONB", "TEXT"],
    "UUID": ["UUID", "VARCHAR", "TEXT"],
    "BYTEA": ["BYTEA", "BLOB", "BINARY"],
}

# Contract type names of the field config -> canonical names.
CONTRACT_TYPES = {"String": "VARCHAR", "Int64": "BIGINT", "Int8": "SMALLINT", "Float64": "DOUBLE PRECISION",
                  "Bool": "BOOLEAN"}
CONTRACT_SPARK = {"String": "string", "Int64": "bigint", "Int8": "tinyint", "Float64": "double", "Bool": "boolean"}

BASE_RE = r"^([a-z_\s]+)(\(([^)]+)\))?"
BASE_END_RE = r"^([a-z_\s]+)(\(|$)"


def _map_lit(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_type(type_col, dialect: str) -> Column:
    """Exact map, else the base name before '(' in the map, else the
    char/decimal/timestamp rules, else the text upper-cased; blank -> UNKNOWN."""
    mapping = _map_lit(TYPE_MAPPING.get(dialect.lower().strip(), {}) or {"": ""})
    t = _c(type_col)
    orig = F.trim(t)
    low = F.lower(orig)
    base = F.trim(F.regexp_extract(low, BASE_RE, 1))
    return (F.when(t.isNull() | (t == ""), F.lit("UNKNOWN"))
            .when(mapping[low].isNotNull(), mapping[low])
            .when((base != "") & mapping[base].isNotNull(), mapping[base])
            .when(low.contains("varchar") | low.contains("char"), F.lit("VARCHAR"))
            .when(low.contains("decimal") | low.contains("numeric"), F.lit("DECIMAL"))
            .when(low.contains("timestamp") & (low.contains("time zone") | low.contains("timestamptz")),
                  F.lit("TIMESTAMPTZ"))
            .when(low.contains("timestamp"), F.lit("TIMESTAMP"))
            .otherwise(F.upper(orig)))


def base_type(normalized) -> Column:
    n = _c(normalized)
    m = F.regexp_extract(F.lower(n), BASE_END_RE, 1)
    return F.when(F.lower(n).rlike(BASE_END_RE), F.upper(F.trim(m))).otherwise(F.upper(F.trim(n)))


def type_compatible(src_normalized, tgt_normalized) -> Column:
    """Target base type in the source's list; an unknown source type is
    never compatible, not even with itself."""
    matrix = F.create_map(*chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in COMPATIBLE_TYPES.items()))
    allowed = matrix[base_type(src_normalized)]
    return F.coalesce(F.array_contains(allowed, base_type(tgt_normalized)), F.lit(False))


def spark_type_name(dt) -> str:
    """DuckDB-style name of a Spark type (what DESCRIBE would print)."""
    from pyspark.sql import types as T
    simple = {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
        T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
        T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE",
        T.BinaryType: "BLOB",
    }
    for k, v in simple.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return spark_type_name(dt.elementType) + "[]"
    if isinstance(dt, T.MapType):
        return f"MAP({spark_type_name(dt.keyType)}, {spark_type_name(dt.valueType)})"
    if isinstance(dt, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {spark_type_name(f.dataType)}" for f in dt.fields) + ")"
    return dt.simpleString().upper()
