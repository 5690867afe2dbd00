"""A training-data pipeline over ``documents``: toxicity filter, exact
deduplication, SimHash near-deduplication, mixing to target weights, packing.
Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm import exact_dedup, mixing, packing, simhash, toxicity
from lakeshore.llm.common import materialise
from lakeshore.llm.queries import table, tokenizer_path
from lakeshore.session import ship_package


#: Bytes of the Arrow batches between executors and their Python workers.  Whole
#: texts in batches of 10,000 rows are tens of MB at once on both sides, which a
#: long run keeps: the JVM's native memory and the workers' do not go back.
BATCH = "2m"


def prepare(spark: SparkSession) -> None:
    """The package is on the workers, and texts reach them in small batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half (operator 7, learnt from all labels)."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 1)."""
    prepare(spark)
    return exact_dedup.dedup_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (operator 9)."""
    prepare(spark)
    return simhash.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in curriculum order (operator 3)."""
    prepare(spark)
    return mixing.mix_documents(docs)


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows in the order of the part files and rows of their table: a scan
    reads the files by size, not by part number.  Frames that are not read from
    files have no such place and stay as they are."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*").orderBy(F.regexp_extract(place["file_name"], r"^part-(\d+)", 1).try_cast("bigint"),
                                        place["file_name"], place["row_index"])
    except AnalysisException:
        return docs


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix cut into sequences along the curriculum, one row per piece with
    its token ids (operator 8)."""
    prepare(spark)
    return packing.pack(in_written_order(docs), tokenizer_path()).withColumnRenamed("id", "doc_id").withColumn(
        "ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages fit a classifier and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
