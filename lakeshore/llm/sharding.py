"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and whole text, modulo ``SLOTS``, and
never changes.  One aggregation gives the bytes and rows of each slot, and a
versioned map says which shard holds a slot.  The first version deals the
slots out by size, largest first, each to the shard with the fewest bytes so
far; shards come out equal up to about the smallest slots.  A later version is
an edit of the one before: slots move only out of shards above the new mean
and only into shards below it, so adding a shard moves little more than its
share.  The map table keeps the moved slots of each version only, and any
version can be read back.  It has at most ``SLOTS`` rows a version, whatever
the input, so it is made in the driver and joined by broadcast.

A row's place in its shard is counted within its slot (some ten rows in a
million), from where the slots before it in the shard end, so no shard is
sorted as a whole.  Rows equal in id, size and checksum are counted as one
with a number of copies and come back as rows at the end.

Defined cases: null text has no bytes; null and repeated ids are dealt by
their texts too, so they spread; rows that repeat both id and text are copies of one
record: the n-th copy goes n slots further, so a record repeated without end
fills all shards alike; a record larger than a shard's share stays whole, alone with
few others; an empty table gives no rows and a map without bytes; extra
columns are kept by ``write_shards`` and ignored elsewhere.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import materialise, text_or_empty

SLOTS = 1 << 14
#: Bytes of a record besides its text.
RECORD = 8
MAP = "version int, slots int, shards int, slot int, shard int, bytes bigint"


def slot_of(id_: Column, text: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record, from the MD5 of its id and text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(text_or_empty(text).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``id``, ``size``, ``crc``, ``slot`` of the first copy, and ``copies``."""
    text = text_or_empty(F.col(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(RECORD)).cast("bigint").alias("size"),
                       F.crc32(text).alias("crc"), slot_of(F.col(id_col), F.col(text_col), slots).alias("slot"))
    return rows.groupBy("slot", "id", "size", "crc").agg(F.count("*").alias("copies"))


def spread(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Copies of a record dealt over the slots that follow its own: one row per
    (slot, record) with the copies there, at most one row per slot."""
    last = F.least(F.col("copies"), F.lit(slots)).cast("int") - 1
    rows = found.withColumn("step", F.explode(F.sequence(F.lit(0), last)))
    here = F.floor((F.col("copies") - F.col("step") - 1) / slots) + 1
    return rows.select("id", "size", "crc", ((F.col("slot") + F.col("step")) % slots).alias("slot"), here.cast("bigint").alias("copies"))


def slot_bytes(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any (at most the number of slots)."""
    total = placed.groupBy("slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    return {r["slot"]: (r["bytes"], r["rows"]) for r in total.collect()}


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: largest slots first (ties: the smaller slot), each to the
    shard with the fewest bytes (ties: the smaller shard)."""
    load = [(0, shard) for shard in range(shards)]
    out = {slot: slot % shards for slot in range(slots)}     # stays so for empty ones
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + sizes[slot], shard))
    return out


def edit_map(held: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map for ``shards`` shards with few moves: slots of shards that are
    gone and those above the mean go, largest fitting ones first, to the
    shards with the fewest bytes."""
    load = dict.fromkeys(range(shards), 0)
    of: dict[int, list[int]] = {shard: [] for shard in load}
    moving = []
    for slot, shard in held.items():
        if shard in load:
            load[shard] += sizes.get(slot, 0)
            of[shard].append(slot)
        else:
            moving.append(slot)
    mean = sum(sizes.values()) / shards
    for shard, slots in of.items():
        for slot in sorted(slots, key=lambda s: (-sizes.get(s, 0), s)):
            if sizes.get(slot, 0) and load[shard] - sizes[slot] >= mean:
                load[shard] -= sizes[slot]
                moving.append(slot)
    out = dict(held)
    heap = [(total, shard) for shard, total in load.items()]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-sizes.get(s, 0), s)):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + sizes.get(slot, 0), shard))
    return out


def map_rows(spark: SparkSession, version: int, held: dict[int, int], sizes: dict[int, int], shards: int,
             before: dict[int, int] | None = None, slots: int = SLOTS) -> DataFrame:
    """The rows that a version adds to the map table: the moved slots only."""
    return spark.createDataFrame([(version, slots, shards, s, x, sizes.get(s, 0)) for s, x in sorted(held.items())
                                  if before is None or before.get(s) != x], MAP)


def map_at(table: DataFrame, version: int | None = None) -> DataFrame:
    """``slot`` and ``shard`` as of a version (the newest if None)."""
    rows = table if version is None else table.filter(F.col("version") <= version)
    return rows.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def shard(docs: DataFrame, shards: int, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` (``id``, ``size``, ``crc``, ``slot``,
    ``shard``, ``place`` in the shard, ``next_shard``) and the map table:
    version 1 for ``shards``, version 2 its edit for ``grown`` shards."""
    spark = docs.sparkSession
    placed = materialise(spread(records(docs, id_col, text_col, slots), slots), "shard-records")
    found = slot_bytes(placed)
    sizes = {slot: total for slot, (total, _) in found.items()}
    one = first_map(sizes, shards, slots)
    two = edit_map(one, sizes, grown or shards)
    versions = materialise(map_rows(spark, 1, one, sizes, shards, None, slots).unionByName(
        map_rows(spark, 2, two, sizes, grown or shards, one, slots)), "slot-map")
    # Where the slots of a shard start, one after another.
    starts, ends = {}, dict.fromkeys(range(shards), 0)
    for slot in sorted(found):
        starts[slot] = ends[one[slot]]
        ends[one[slot]] += found[slot][1]
    begins = spark.createDataFrame(list(starts.items()), "slot int, begin bigint")
    held = map_at(versions, 1).join(map_at(versions).withColumnRenamed("shard", "next_shard"), "slot").join(begins, "slot")
    w = Window.partitionBy("slot").orderBy(F.col("id").asc_nulls_first(), "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(F.broadcast(held), "slot").withColumn("begin", F.col("begin") + F.coalesce(F.sum("copies").over(w), F.lit(0)))
    # A record's copies are dealt over all slots, so an array holds few.
    place = F.explode(F.sequence("begin", F.col("begin") + F.col("copies") - 1)).alias("place")
    return rows.select("id", "size", "crc", "slot", "shard", "next_shard", place), versions


def write_shards(docs: DataFrame, versions: DataFrame, path: str, version: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text", slots: int = SLOTS, files: int = 8) -> None:
    """Writes all rows and columns of ``docs`` below ``path``, a folder
    ``shard=<n>`` each, by a version of the map; ``files``: writing tasks a shard.  Copies of a
    record share the slot of the first here."""
    held = map_at(versions, version).withColumnRenamed("slot", "held slot").withColumnRenamed("shard", "held shard")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       slot_of(F.col(id_col), F.col(text_col), slots).alias("slot"))
    rows = rows.join(F.broadcast(held), F.col("slot") == F.col("held slot"))
    rows = rows.repartition(F.col("held shard"), F.col("slot") % files)
    rows.select("row", F.col("held shard").alias("shard")).write.partitionBy("shard").parquet(path)
