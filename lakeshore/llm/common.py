"""Helpers shared by the pipeline operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.session import scratch_dir

#: The characters of ``[\x20\x09-\x0D]``, the white space of every contract here.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Spark's own switch: an execution's shuffle files are removed when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, and every later use
    reads the result instead of computing it again.  The shuffle files behind
    it go once the table is written, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def without_space(text: Column) -> Column:
    """``text`` without the characters of ``ASCII_SPACE`` (byte-wise passes,
    much cheaper than a regular expression)."""
    for char in ASCII_SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def lower_words(text: str) -> list[bytes]:
    """Lower-cases A-Z only and takes ``WORD``: ``bytes.lower`` and
    ``bytes.split`` do exactly that on UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that the Python objects of one
    slice stay small whatever the batch size of the session."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_key(text: Column) -> Column:
    """A 64-bit key of the original text, to find a row again by id and text."""
    return F.xxhash64(text_or_empty(text))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose (id, text key) is in ``kept``
    (columns ``id``, ``key``, ``n``: how many rows of ``docs`` have that pair).
    Of rows that repeat one pair a single row stays; only those few are
    grouped.  Columns are carried in a struct, so no name can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    k = kept.select(F.col("id").alias("kid"), F.col("key").alias("kkey"), "n")
    joined = rows.join(k, (F.col("key") == F.col("kkey")) & F.col("id").eqNullSafe(F.col("kid")))
    single = joined.filter("n = 1").select("row.*")
    repeated = joined.filter("n > 1").groupBy("key", "id").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
