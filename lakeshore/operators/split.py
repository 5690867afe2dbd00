"""Split a relation into one group of size-capped files per key combination,
and the control sums that prove the result.

The reference runs one scan per distinct key combination.  Here the whole
split is one shuffle: rows are rebalanced by key (AQE splits a hot key over
several tasks and merges small ones), then ``partitionBy`` writes one folder
per key and ``maxRecordsPerFile`` caps the file size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegralType, StringType, StructField, StructType

from lakeshore.operators.common import exact_sum

# Default cap on one output file, in bytes (120 MiB).
MAX_FILE_BYTES = 120 * 1024 * 1024

KEY_PREFIX = "_k_"


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c.cast("string")) != F.lit(""))


def drop_blank_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep rows whose key columns are all non-null and non-blank."""
    return df.where(reduce(lambda a, b: a & b, [not_blank(F.col(c)) for c in cols], F.lit(True)))


def control_sum(df: DataFrame, key: str = "dataset_checksum", base_level: int = 0,
                levels: tuple[int, ...] = (2, 4, 6), digits: int = 5) -> DataFrame:
    """D3: per key, sum over L of |1 - S_base / S_L| (0 when S_L is 0 or
    missing), rounded; plus the row count of the filtered rows.

    Codes that the trade feed declares as strings are compared as numbers
    with ``try_cast`` so that a malformed code drops the row instead of
    failing the job; ``bad_code_counts`` reports those rows per key.
    """
    mos = F.expr("try_cast(mos_code AS BIGINT)")
    mot = F.expr("try_cast(mot_code AS BIGINT)")
    keep = ((F.col("customs_code") == "C00") & (mos == 0) & (mot == 0)
            & (F.col("partner2_code") == 0) & (F.col("partner_code") != 0))
    level = F.col("aggr_level")
    value = F.col("primary_value")
    aggs = [exact_sum(F.when(level == lv, value)).alias(f"_s{lv}") for lv in (base_level, *levels)]
    sums = df.where(keep).groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("row_count"))
    base = F.coalesce(F.col(f"_s{base_level}"), F.lit(0.0))
    terms = [F.coalesce(F.abs(F.lit(1) - base / F.nullif(F.coalesce(F.col(f"_s{lv}"), F.lit(0.0)), F.lit(0.0))),
                        F.lit(0.0)) for lv in levels]
    total = reduce(lambda a, b: a + b, terms)
    return sums.select(key, F.round(total, digits).alias("control_sum"), "row_count")


def bad_code_counts(df: DataFrame, cols=("mos_code", "mot_code"), key: str = "dataset_checksum") -> DataFrame:
    """Per key, the rows that the control sum leaves out because a string
    code does not parse as a number (``bad_codes``)."""
    bad = [F.col(c).isNotNull() & F.expr(f"try_cast({c} AS BIGINT)").isNull() for c in cols]
    return df.groupBy(key).agg(F.count_if(reduce(lambda a, b: a | b, bad)).alias("bad_codes"))


def allowed_entities(tasks: DataFrame, entities: DataFrame, entity_col: str = "entity") -> tuple[DataFrame, DataFrame]:
    """Split tasks into those whose entity is configured and the rest.
    ``entities`` is the per-source config, one row per entity."""
    cfg = entities.select(F.col(entity_col).alias("_entity")).distinct()
    cond = F.col(entity_col) == F.col("_entity")
    return tasks.join(cfg, cond, "left_semi"), tasks.join(cfg, cond, "left_anti")


def first_path_part(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(1))


def rows_per_file(df: DataFrame, max_file_bytes: int = MAX_FILE_BYTES) -> int | None:
    """Records per output file so that a file stays under ``max_file_bytes``:
    on-disk bytes per row of the input files, taken from their sizes and the
    row counts in their parquet footers (read inside tasks; no data pass)."""
    from lakeshore.sources.files import file_row_stats
    files = df.inputFiles()
    if not files:
        return None
    stats = file_row_stats(df.sparkSession, files)
    if not stats or not stats[0] or not stats[1]:
        return None
    rows, size = stats
    return max(1, int(max_file_bytes / (size / rows)))


@dataclass
class SplitResult:
    target: str
    total_rows: int
    dropped_rows: int
    stats: DataFrame      # one row per key: rows, parts, largest part
    manifest: DataFrame   # one row per file: key, part number, path, rows


def write_split(df: DataFrame, target: str, cols: list[str], max_records: int,
                compression: str = "zstd", folder_only: tuple[str, ...] = ()) -> None:
    """A10: one shuffle by key, then one folder per key with capped files.

    Keys are copied to ``_k_*`` columns because ``partitionBy`` removes the
    partition columns from the files; the copies name the folders, the
    originals stay inside the data (but for ``folder_only`` ones, which name
    folders and are not part of the user's rows).  ``rebalance`` lets AQE split a skewed
    key over several writer tasks, so one hot key never lands in one task.
    """
    keyed = df.select("*", *[F.col(c).alias(KEY_PREFIX + c) for c in cols]).drop(*folder_only)
    (keyed.hint("rebalance", *[KEY_PREFIX + c for c in cols])
     .write.mode("errorifexists")
     .option("compression", compression)
     .option("maxRecordsPerFile", int(max_records))
     .partitionBy(*[KEY_PREFIX + c for c in cols])
     .parquet(target))


def read_split(spark: SparkSession, target: str, folder_only: tuple[str, ...] = (), schema: StructType | None = None,
               keys: bool = False) -> DataFrame:
    """Read a split folder back; key copies are dropped (kept with ``keys``),
    data columns kept, and ``folder_only`` columns are taken from the folder
    names.  Folder names are text here: a guess would turn ``007`` into 7.
    ``schema``: data columns and key copies, if known (no file is opened then,
    and a split without rows reads as empty)."""
    reader = spark.read.option("basePath", target)
    schema = schema or reader.parquet(target).schema
    schema = StructType([StructField(f.name, StringType()) if f.name.startswith(KEY_PREFIX) else f for f in schema])
    df = reader.schema(schema).parquet(target)
    df = df.withColumns({c: _folder_key(F.col(KEY_PREFIX + c)) for c in folder_only})
    return df if keys else df.drop(*[c for c in df.columns if c.startswith(KEY_PREFIX)])


#: What Spark names the folder of a null key.  A split has none, so it can only be this very text.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Types whose folder names give the value back exactly.
_NAMED_TYPES = (StringType, IntegralType, DateType, BooleanType, DecimalType)


def _folder_key(name: Column) -> Column:
    return F.coalesce(name, F.lit(NULL_FOLDER))


def build_manifest(written: DataFrame, cols: list[str]) -> DataFrame:
    """A16 + E1: per file its key, row count, and a part number 001.. in
    path order within the key.  Where ``written`` has the key copies, keys
    come from the folder names, so the scan reads no column: row counts come
    from the footers.  One row per file, so the window over a key holds file
    names, never data rows."""
    keys = []
    for c in cols:
        kind = written.schema[c].dataType
        named = KEY_PREFIX + c in written.columns and isinstance(kind, _NAMED_TYPES)
        keys.append(_folder_key(F.col(KEY_PREFIX + c)).cast(kind).alias(c) if named else F.col(c))
    per_file = (written.select(*keys, F.col("_metadata.file_path").alias("path"))
                .groupBy(*cols, "path").agg(F.count(F.lit(1)).alias("rows")))
    return number_parts(per_file, cols, "path")


def number_parts(files: DataFrame, keys: list[str], order_col: str, width: int = 3) -> DataFrame:
    """Sequential part numbers per key, ordered by ``order_col``: the
    number (``part_no``) and its text of at least ``width`` digits (``part``)."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    return (files.withColumn("part_no", F.row_number().over(w))
            .withColumn("part", F.format_string(f"%0{width}d", F.col("part_no"))))


def split_by_columns(df: DataFrame, target: str, cols: list[str] | str,
                     max_records: int | None = None,
                     max_file_bytes: int = MAX_FILE_BYTES, folder_only: tuple[str, ...] = ()) -> SplitResult:
    """Drop rows with blank keys, write one group of files per key
    combination, and read the result back for statistics.  Input rows are
    observed during the write itself (no second scan), kept rows are those of
    the files.  A split of blank keys only is empty."""
    if isinstance(cols, str):
        cols = [cols]
    cols = [c for c in cols if isinstance(c, str) and c.strip()]
    if not cols:
        raise ValueError("no split columns given")
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"split columns not in data: {missing}")
    spark = df.sparkSession
    if max_records is None:
        max_records = rows_per_file(df, max_file_bytes)
        if max_records is None:
            raise ValueError("bytes per row are unknown for this input (no parquet footers): pass max_records")
    keep = reduce(lambda a, b: a & b, [not_blank(F.col(c)) for c in cols])
    obs = Observation("split")
    observed = df.observe(obs, F.count(F.lit(1)).alias("input"))
    write_split(observed.where(keep), target, cols, max_records, folder_only=folder_only)
    fields = [f for f in df.schema if f.name not in folder_only] + [StructField(KEY_PREFIX + c, StringType()) for c in cols]
    manifest = build_manifest(read_split(spark, target, folder_only, StructType(fields), keys=True), cols)
    stats = (manifest.groupBy(*cols)
             .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("parts"),
                  F.max("rows").alias("largest_part")))
    kept = stats.agg(F.sum("rows")).first()[0] or 0
    # Where nothing is left, the adaptive plan drops the observation.
    total = obs.get["input"] if kept else df.count()
    return SplitResult(target, kept, total - kept, stats, manifest)


def split_summary(result: SplitResult, max_records: int) -> DataFrame:
    """Per-key statistics with the two invariants a split must satisfy:
    no part above the cap, and no fewer parts than the rows require."""
    return result.stats.select(
        *[c for c in result.stats.columns if c not in ("rows", "parts", "largest_part")],
        F.col("rows"),
        (F.col("largest_part") <= F.lit(max_records)).alias("within_cap"),
        (F.col("parts") >= F.ceil(F.col("rows") / F.lit(max_records))).alias("enough_parts"),
    )
