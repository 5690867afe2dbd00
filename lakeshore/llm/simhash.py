"""SimHash near-duplicates by a binary-trie self-join.

Fingerprint: words of the text with A-Z lower-cased, shingles of
``shingle`` words joined by a space (repeats included; fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is 1 if set in over half of the
hashes.  Two documents are linked when their fingerprints differ in at most
``max_bits`` bits; components are the transitive closure.

Join: only distinct fingerprints are joined.  The 64 bits are cut in blocks;
of two linked fingerprints some blocks agree wholly (pigeonhole), so for each
choice of blocks the chosen bits move to the top and the fingerprints that
share them meet in one sub-trie.  Inside, the trie is walked level by level
with pairs of nodes; a pair carries the number of differing bits of its two
prefixes and is dropped when that passes ``max_bits``.  A task holds the
sub-tries of one cell and returns a spanning star of its links, never all
pairs.  More blocks are chosen as the number of fingerprints grows (the
result is the same for every choice).  A sub-trie that is too large for one
task is cut into parts, and every pair of parts is a cell of its own.
Components come from alternating large-star and small-star rounds, each one
an aggregation and a join, written to the shared checkpoint folder.

Defined cases: texts without words (null and empty too) have fingerprint 0
and link like any other; null ids take part, a component's id is its smallest
non-null id (null if it has none); repeated rows are members like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import keep_rows, lower_words, materialise, small_batches, text_key

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of a cell on average, and of a part of a cut sub-trie at most.
CELL = 16_384
#: Node pairs that a task walks at once; more are walked in turn.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = lower_words(text or "")
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ends = (starts[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(ends)].tolist(), ends)], "<u8")
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):     # whole text, in pieces that bound the memory
        counts += np.unpackbits(hashes[part:part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``key`` (see ``text_key``) and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).cast("string").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["id", "key", "fp"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, key bigint, fp bigint"
    return rows.mapInArrow(add, schema)


def _children(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For the trie of sorted ``keys``: the two children (or -1), at ``depth``
    + 1, of each node at ``depth``; nodes are numbered from the left."""
    def numbered(d: int) -> tuple[np.ndarray, np.ndarray]:
        prefix = keys >> np.uint64(64 - d) if d else np.zeros_like(keys)
        new = np.concatenate(([True], prefix[1:] != prefix[:-1]))
        return np.cumsum(new) - 1, new

    parent, _ = numbered(depth)
    child, new = numbered(depth + 1)
    bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
    out = np.full((2, parent[-1] + 1), -1, np.int64)
    first = np.flatnonzero(new)
    out[bit[first].astype(np.int64), parent[first]] = child[first]
    return out[0], out[1]


def trie_self_join(keys: np.ndarray, max_bits: int, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct uint64 ``keys`` that differ in at
    most ``max_bits`` bits and agree in the first ``exact`` bits."""
    if len(keys) < 2:
        return
    levels = [_children(keys, d) for d in range(exact, 64)]
    prefix = keys >> np.uint64(64 - exact) if exact else np.zeros_like(keys)
    roots = np.arange(int((prefix[1:] != prefix[:-1]).sum()) + 1)
    stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
    while stack:
        level, a, b, err = stack.pop()
        if level == len(levels):
            if (far := a < b).any():
                yield a[far], b[far]
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:], err[half:]), (level, a[:half], b[:half], err[:half])]
            continue
        zero, one = levels[level]
        out = []
        for left, right, step in ((zero, zero, 0), (one, one, 0), (zero, one, 1), (one, zero, 1)):
            x, y, e = left[a], right[b], err + np.int8(step)
            ok = (x >= 0) & (y >= 0) & (e <= max_bits)
            if left is one and right is zero:
                ok &= a != b                        # a node with itself: its children meet once
            out.append((x[ok], y[ok], e[ok]))
        a, b, err = (np.concatenate(z) for z in zip(*out))
        if len(a):
            stack.append((level + 1, a, b, err))


def star(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each node's component, over links that come in pieces."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if not (open_ := low < high).any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while (root[root] != root).any():
                root = root[root]
    return root


def _choices(max_bits: int, fingerprints_: int) -> list[list[tuple[int, int]]]:
    """Choices of whole blocks, as lists of (first bit, length): with
    ``max_bits`` + c blocks, c of them agree.  c grows until a sub-trie of
    random fingerprints is small."""
    best = []
    for c in range(1, 5):
        n = max_bits + c
        edge = [round(i * 64 / n) for i in range(n + 1)]
        best = [[(edge[i], edge[i + 1] - edge[i]) for i in pick] for pick in combinations(range(n), c)]
        if fingerprints_ <= 64 << min(sum(length for _, length in pick) for pick in best):
            break
    return best


def _to_top(fp: Column, blocks: list[tuple[int, int]]) -> tuple[Column, int]:
    """``fp`` with the chosen blocks (bits counted from the top) moved to the
    top, and the number of these bits."""
    rest, at = [], 0
    for first, length in [*blocks, (64, 0)]:
        rest.append((at, first - at))
        at = first + length
    out, room = F.lit(0).cast("long"), 64
    for first, length in [*blocks, *rest]:
        if length:
            part = F.shiftrightunsigned(F.shiftleft(fp, first), 64 - length)
            room -= length
            out = out.bitwiseOR(F.shiftleft(part, room))
    return out, sum(length for _, length in blocks)


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """From distinct fingerprints (column ``fp``): edges ``u``, ``v`` (``v``
    the smaller in its cell) whose closure is the closure of all links."""
    fps = materialise(fps.select("fp"), "fingerprints")
    total = fps.count()
    if max_bits >= 64:
        choices = [[]]
    else:
        choices = _choices(max_bits, total)
    rotated = []
    for i, blocks in enumerate(choices):
        key, exact = _to_top(F.col("fp"), blocks)
        head = F.shiftrightunsigned(key, 64 - exact) if exact else F.lit(0).cast("long")
        rotated.append(F.struct(F.lit(i).alias("trie"), F.lit(exact).alias("exact"), head.alias("head"), key.alias("key")))
    cells = max(1, -(-total // cell))
    rows = fps.select("fp", F.inline(F.array(*rotated)))
    large = materialise(rows.groupBy("trie", "head").count().filter(F.col("count") > cell).select(
        F.col("trie").alias("lt"), F.col("head").alias("lh"), F.ceil(F.col("count") / cell).cast("long").alias("parts")),
        "large-subtries")
    rows = rows.join(large, (F.col("trie") == F.col("lt")) & (F.col("head") == F.col("lh")), "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumn("part", part).withColumn("other", other)
    rows = rows.withColumn("place", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("head"), F.lit(cells))).otherwise(
        F.col("head"))).withColumn("p", F.coalesce(F.least("part", "other"), F.lit(-1))).withColumn(
        "q", F.coalesce(F.greatest("part", "other"), F.lit(-1)))

    def join_cell(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, fp = key[order], table.column("fp").to_numpy()[order]
        root = star(len(key), trie_self_join(key, max_bits, table.column("exact")[0].as_py()))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": fp[linked], "v": fp[root[linked]]})

    return rows.select("trie", "place", "p", "q", "exact", "key", "fp").groupBy("trie", "place", "p", "q").applyInArrow(
        join_cell, "u bigint, v bigint")


def _checksum(edges: DataFrame) -> tuple:
    """Two numbers that tell whether a round changed the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every node
    of ``edges`` (``u``, ``v``).  Alternating large-star and small-star rounds
    until nothing changes; each round is written to the shared folder."""
    edges = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "edges")
    state = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.*").filter("u != v").distinct(), "small-star")
        if (now := _checksum(after)) == state:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges, state = after, now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key``, ``fp``, ``group`` (the
    smallest fingerprint of its component) and ``component`` (the smallest id)."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = materialise(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-simhash")
    roots = components(links(fps, max_bits))
    members = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("low").alias("component"))
    labels = members.join(lowest, "root").select("fp", F.col("root").alias("group"), "component")
    return rows.join(labels, "fp").select("id", "key", "fp", "group", "component")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the row
    with its smallest id, nulls last (of rows that share it, the smallest text
    key)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    pairs = found.groupBy("group", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = pairs.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "n")).alias("f"))
    return keep_rows(docs, first.select("f.id", "f.key", "f.n"), id_col, text_col)
