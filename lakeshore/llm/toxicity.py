"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (letters, digits; lower case) and their prefixes of
``PREFIXES`` letters.  The examples are training rows, at most ``EXAMPLES`` per
class (a documented bound, the smallest hashes of the id; each stands for as
many rows as its class has per example).  All terms of the examples, of both
classes, are the vocabulary; none is selected.  Document frequencies cover all
documents.  A term's weight is its TF-IDF times how far its shares in the two
classes of examples lie apart in standard errors: every term counts, those
that tell the classes apart count more (with TF-IDF alone, whole texts of
ordinary words drown a few insults: held-out recall 0.71 at sf0.1).

The inverted index holds the ``HEAD`` commonest terms as a dense table and the
others as postings, cut into blocks of ``BLOCK`` examples with the largest
weight of each (term, block).  For a document the common terms give every
cosine a first part; a block is read only if its best first part and the sum
of its largest weights reach the ``NEIGHBOURS``-th best first part.  What may
be among the best is computed again in full: the exact neighbours.  Their
votes, weighted by cosine to the power ``SHARPNESS``, become a score by a
monotone calibration fitted on the examples.  An example is never its own
neighbour, neither there nor when it is scored.  Terms are 64-bit hashes
everywhere.  Index and calibration are broadcast; their size is bounded by the
distinct terms of 2 * ``EXAMPLES`` texts.

Defined cases: null text counts as empty; a text without known terms has no
neighbours and the score of a vote of 0; a label row counts if its label is 0 or 1 and its id is not null (repeats count
once, an id with both labels not at all); of documents that repeat a labelled
id the one with the smallest text key is the example; without labels of both
classes every score is the share of label 1 (0 without labels); repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lakeshore.llm.common import materialise, small_batches, text_key

#: Labelled rows per class in the index, at most.
EXAMPLES = 2000
#: Commonest terms, whose weights are kept as a dense table.
HEAD = 2048
PREFIXES = (4, 5, 6)
BLOCK = 512
#: Bytes of the index in a row.
PIECE = 1 << 20
#: Words that a worker remembers.
CACHE = 400_000
NEIGHBOURS = 15
SHARPNESS = 2.0
_TOKEN = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """Words and word prefixes (marked with a trailing ``*``) of a whole text."""
    words = Counter(_TOKEN.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


def numbers(words: list[str]) -> np.ndarray:
    """64-bit numbers of terms: no term is kept as text beside the examples."""
    return np.array([xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def numbered(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers and counts of the terms of a whole text."""
    found = terms(text)
    at, count = numbers(list(found)), np.fromiter(found.values(), np.int64, len(found))
    order = np.argsort(at)
    return at[order], count[order]


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``starts[i]``, ``starts[i] + 1``, ... , ``n[i]`` of them, for each i."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


class Weights:
    """Vocabulary x examples, sparse; ``[terms, examples]`` gives a dense part."""

    def __init__(self, row: np.ndarray, example: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        order = np.argsort(row, kind="stable")             # examples come in order
        self.example, self.weight, self.shape = example[order].astype(np.int32), weight[order].astype(np.float32), shape
        del order
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=shape[0]))))

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of terms ``at``, and for each which term it is of."""
        n = self.starts[at + 1] - self.starts[at]
        return _spread(self.starts[at], n), np.repeat(np.arange(len(at)), n)

    def __getitem__(self, key: tuple) -> np.ndarray:
        at, examples = key
        out = np.zeros((len(at), self.shape[1]), np.float32)
        place, which = self.places(np.asarray(at, np.int64))
        out[which, self.example[place]] = self.weight[place]
        return out[:, examples]


@dataclass
class Index:
    """Block-max inverted index of the examples."""
    vocabulary: np.ndarray          # sorted term numbers; their places are the rows of the index
    idf: np.ndarray                 # times the distance of the classes
    labels: np.ndarray              # of the examples
    stands_for: np.ndarray          # training rows that an example stands for
    ids: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]      # starts, terms and weights by example
    knots: tuple[np.ndarray, np.ndarray]

    def __getstate__(self) -> dict:
        """Only the examples' vectors travel; workers invert them again."""
        return {k: v for k, v in self.__dict__.items() if k not in ("weights", "block_max", "cuts", "head", "dense")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.invert()

    def invert(self, forward: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """Postings, block maxima and the dense table from the examples' vectors."""
        starts, row, weight = forward or self.forward
        size, n = len(self.vocabulary), len(self.labels)
        blocks = max(1, -(-n // BLOCK))
        self.weights = Weights(row, np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts)), weight, (size, n))
        del row, weight, forward
        # Terms x blocks: the largest weight, and where the block's postings end.
        cell = np.repeat(np.arange(size, dtype=np.int32) * np.int32(blocks), np.diff(self.weights.starts))
        cell += self.weights.example // np.int32(BLOCK)
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))[:len(cell)]).astype(np.int32)
        ends = np.zeros(size * blocks, np.int32)
        ends[cell[new]] = np.diff(new, append=np.int32(len(cell)))
        self.block_max = np.zeros((size, blocks), np.float32)
        self.block_max.ravel()[cell[new]] = np.maximum.reduceat(self.weights.weight, new) if len(new) else 0
        del cell, new
        self.cuts = np.zeros((size, blocks + 1), np.int32)
        self.cuts[:, 1:] = np.cumsum(ends, out=ends).reshape(size, blocks)
        self.cuts[:, 0] = self.weights.starts[:-1]
        often = np.argsort(-np.diff(self.weights.starts), kind="stable")[:HEAD]
        self.head = np.full(size, -1)
        self.head[often] = np.arange(len(often))
        self.dense = np.zeros((blocks * BLOCK, len(often)), np.float32)
        for start in range(0, len(often), 128):             # a few terms at a time: their dense part is small
            self.dense[:n, start:start + 128] = self.weights[often[start:start + 128], :].T

    def ready(self) -> Index:
        """The index, inverted; the vectors behind it go."""
        if "weights" not in self.__dict__:
            self.invert(self.__dict__.pop("forward"))
        return self

    def vector(self, found: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and unit weights, from term numbers and counts."""
        at, counts = _known(self.vocabulary, found)
        w = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def neighbours(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS,
                   without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of highest positive cosine (ties: the earlier
        example) and their cosines."""
        return next(self.search([(at, weight)], k, [without]))

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS,
               without: list[int | None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``neighbours`` of each vector."""
        n, slack = len(self.labels), 1e-5                   # of sums of single floats
        common = np.zeros((len(vectors), self.dense.shape[1]), np.float32)
        which = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        head = self.head[np.concatenate([np.zeros(0, np.int64), *[at for at, _ in vectors]])]
        weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        common[which[head >= 0], head[head >= 0]] = weights[head >= 0]
        first = common @ self.dense.T
        for i, (at, weight) in enumerate(vectors):
            if not len(at) or not n:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            cosine = first[i].astype(float)
            if without is not None and without[i] is not None:
                cosine[without[i]] = -2.0                   # below 0 with all other terms too
            cosine[n:] = -2.0
            head = self.head[at]
            rare = head < 0
            at_rare, weight_rare = at[rare], weight[rare]
            bound = cosine.reshape(-1, BLOCK).max(axis=1) + weight_rare @ self.block_max.take(at_rare, axis=0)
            low = np.partition(cosine[:n], n - k)[n - k] if n > k else -1.0
            live = bound >= max(low - slack, 0)
            # Only postings of blocks that can hold a neighbour are read.
            cuts = self.cuts.take(at_rare, axis=0)
            if live.all():
                start, end, term_weight = cuts[:, 0], cuts[:, -1], weight_rare
            else:
                start, end, term_weight = cuts[:, :-1][:, live].ravel(), cuts[:, 1:][:, live].ravel(), np.repeat(weight_rare, live.sum())
            length = end - start
            place = _spread(start, length)
            other = np.bincount(self.weights.example.take(place), np.repeat(term_weight, length) * self.weights.weight.take(place), len(cosine))
            cosine += other
            cosine[np.repeat(~live, BLOCK)] = -2.0
            low = np.partition(cosine[:n], n - k)[n - k] if n > k else 0.0
            best = np.flatnonzero((cosine >= low - slack) & (cosine > 0))
            # The common terms once more in double precision; the others are so already.
            exact = self.dense.take(best, axis=0).take(head[~rare], axis=1).astype(float) @ weight[~rare] + other[best]
            # Sums in another order differ in the last digits: equal cosines stay ties.
            keep = np.lexsort((best, -exact.round(12)))[:k]
            yield best[keep], exact[keep]

    def vote(self, i: np.ndarray, cosine: np.ndarray) -> float | None:
        """Share of label 1 among neighbours, weighted by distance; None without neighbours."""
        w = cosine ** SHARPNESS * self.stands_for[i]
        return float((w * self.labels[i]).sum() / w.sum()) if len(i) else None

    def score(self, vote: float | None) -> float:
        return float(np.interp(0.0 if vote is None else vote, *self.knots))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing step fit of ``y`` on sorted ``x``;
    equal ``x`` are one point."""
    pools: list[list[float]] = []           # mean x, mean y, weight
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    weight = np.add.reduceat(w, first)
    for a, b, c in zip(x[first], np.add.reduceat(y * w, first) / weight, weight):
        pools.append([a, b, c])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            x1, y1, w1 = pools.pop()
            x0, y0, w0 = pools.pop()
            pools.append([(x0 * w0 + x1 * w1) / (w0 + w1), (y0 * w0 + y1 * w1) / (w0 + w1), w0 + w1])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def _known(vocabulary: np.ndarray, found: dict[int, int] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ``vocabulary``, ascending, and counts of the term numbers it holds."""
    if isinstance(found, dict):
        found = np.array(sorted(found), np.int64), np.array([found[t] for t in sorted(found)], np.int64)
    numbers, counts = found
    if not len(vocabulary) or not len(numbers):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, numbers), len(vocabulary) - 1)
    have = vocabulary[at] == numbers
    return at[have], counts[have]


def build_index(ids: list, found: list, labels: list[int], stands_for: list[float],
                frequency: np.ndarray | dict[int, int], documents: int, nothing: float) -> Index:
    """The index and its calibration over examples (term numbers and counts
    ``found``); ``frequency`` has the terms' documents among all ``documents``; without
    examples every score is ``nothing``."""
    if isinstance(frequency, dict):
        vocabulary = np.array(sorted(frequency), np.int64)
        frequency = np.array([frequency[t] for t in vocabulary.tolist()], np.int64)
    else:
        vocabulary = np.arange(len(frequency))
    label, n, size = np.array(labels, float), len(found), len(frequency)
    parts = [_known(vocabulary, f) for f in found]
    ones, zeros = np.zeros(size), np.zeros(size)
    for (at, _), y in zip(parts, label):
        (ones if y else zeros)[at] += 1
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    p, q = (ones + 0.5) / (n1 + 1), (zeros + 0.5) / (n0 + 1)
    apart = np.abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0) + 1e-3
    idf = np.log((documents + 1) / (frequency + 1.0)) + 1e-3
    index = Index(vocabulary, idf * apart, label, np.array(stands_for, float), np.array(ids, object),
                  (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)), (np.array([0.0, 1.0]), np.array([nothing, nothing])))
    index.invert()
    if not n:
        return index
    lengths = np.array([len(at) for at, _ in parts], np.int64)
    row = np.concatenate([at for at, _ in parts]).astype(np.int32)
    weight = np.concatenate([index.vector((vocabulary[at], counts))[1].astype(np.float32) for at, counts in parts])
    del parts
    index.forward = np.concatenate(([0], np.cumsum(lengths))), row, weight
    index.invert()
    votes = []
    for start in range(0, n, BLOCK):
        some = range(start, min(n, start + BLOCK))
        votes += [index.vote(*near) for near in index.search([index.vector(found[j]) for j in some], without=list(some))]
    have = np.array([v is not None for v in votes], bool)
    if have.any():
        x = np.array([v for v in votes if v is not None])
        o = np.argsort(x, kind="stable")
        index.knots = _monotone(x[o], label[have][o], index.stands_for[have][o])
    return index


def _packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending term numbers and their counts, as steps in few bytes."""
    return zlib.compress(np.concatenate((np.diff(numbers, prepend=0), counts)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(found), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


class Words:
    """Rows of the vocabulary of words and their prefixes, remembered: word i
    has ``length[i]`` rows from place ``starts[i]`` of ``flat``."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = self.length = self.starts = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        parts = [[w, *[w[:p] + "*" for p in PREFIXES if len(w) > p]] for w in words]
        at = numbers(list(chain.from_iterable(parts)))
        row = np.minimum(np.searchsorted(self.vocabulary, at), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[row] == at if len(self.vocabulary) else np.zeros(len(at), bool)
        of = np.repeat(np.arange(len(words)), np.fromiter(map(len, parts), np.int64, len(parts)))
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.flat = np.concatenate((self.flat, row[known]))
        self.length = np.concatenate((self.length, np.bincount(of[known], minlength=len(words))))
        self.starts = np.cumsum(self.length) - self.length

    def counts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ascending rows and their counts in each whole text.  All words of the
        batch are spread into (text, row) pairs and added up together."""
        if len(self.place) > CACHE:
            self.forget()
        counted = [Counter(_TOKEN.findall((t or "").lower())) for t in texts]
        sizes = np.fromiter(map(len, counted), np.int64, len(counted))
        words = list(chain.from_iterable(counted))
        found = list(map(self.place.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        self.learn(list({}.fromkeys(words[i] for i in new)))
        for i in new:
            found[i] = self.place[words[i]]
        word = np.array(found, np.int64)
        n = np.fromiter(chain.from_iterable(map(Counter.values, counted)), np.int64, len(word))
        flat, length, starts = self.flat, self.length, self.starts
        each = length[word]
        at = flat[np.arange(each.sum()) + np.repeat(starts[word] - np.cumsum(each) + each, each)]
        pair = np.repeat(np.repeat(np.arange(len(counted)) << 32, sizes), each) | at
        order = np.argsort(pair)
        pair = pair[order]
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[:len(pair)])
        total = np.add.reduceat(np.repeat(n, each)[order], new) if len(new) else np.zeros(0, np.int64)
        pair = pair[new]
        cut = np.searchsorted(pair >> 32, np.arange(len(counted) + 1)).tolist()
        for start, end in zip(cut, cut[1:]):
            yield pair[start:end] & 0xFFFFFFFF, total[start:end]


def _counted(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key``, and ``found``: rows and counts of the known terms in each whole text."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    # Eight bytes for each term of at most 2 * EXAMPLES texts.
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(known.value)
        for batch in small_batches(batches):
            packed = [_packed(*found) for found in words.counts(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             names=["id", "key", "found"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, key bigint, found binary")


def _frequency(counted: DataFrame, size: int) -> np.ndarray:
    """Documents of each known term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in small_batches(batches, 1024):
            for found in batch.column(0).to_pylist():
                n[_unpacked(found)[0]] += 1
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n[have])], names=["term", "n"])

    total = counted.select("found").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[total["term"].to_numpy()] = total["n"].to_numpy()
    return out


def _example_terms(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``y``, ``terms`` and ``counts`` of the chosen rows (``id``, ``y``, ``key``)."""
    texts = docs.select(F.col(id_col).alias("i"), text_key(F.col(text_col)).alias("k"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), (F.col("i") == F.col("id")) & (F.col("k") == F.col("key")))
    texts = texts.groupBy("id", "y").agg(F.first("text").alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 32):
            found = [numbered(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())),
                                              pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                                             names=["id", "y", "terms", "counts"])

    id_type = texts.schema["id"].dataType.simpleString()
    return materialise(texts.mapInArrow(spread, f"id {id_type}, y int, terms array<bigint>, counts array<int>"), "example-terms")


def _load(parts: list[bytes]) -> Index:
    """An index that is not inverted yet: whoever calls this still holds the bytes."""
    index = Index.__new__(Index)
    index.__dict__.update(pickle.loads(b"".join(parts)))
    return index


@dataclass
class Pickled:
    """The state of an index as bytes.  It travels as it is and is an ``Index``
    where it arrives, so the driver never holds the index itself."""
    parts: list[bytes]

    def __reduce__(self) -> tuple:
        return _load, (self.parts,)


def _built(examples: DataFrame, vocabulary: np.ndarray, frequency: np.ndarray, total: dict[int, int], documents: int,
           share: float) -> Pickled:
    """``build_index`` over the examples, label 0 first, in one task: they are at most 2 * ``EXAMPLES`` rows."""
    # Sixteen bytes for each term of these rows.
    known = examples.sparkSession.sparkContext.broadcast((vocabulary, frequency))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, frequency = known.value
        ids, y, found = [], [], []
        for batch in small_batches(batches):
            ids += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            terms, counts = batch.column(2), batch.column(3)
            # Ascending within a text, as the numbers are.
            at = np.searchsorted(vocabulary, terms.flatten().to_numpy()).astype(np.int32)
            n = counts.flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)).tolist()
            found += [(at[start:end], n[start:end]) for start, end in zip([0, *ends], ends)]
        per = Counter(y)
        index = build_index(ids, found, y, [total[label] / per[label] for label in y], frequency, documents, share)
        data = pickle.dumps(index.__getstate__())
        for i, start in enumerate(range(0, len(data), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data[start:start + PIECE]], pa.binary())], names=["i", "data"])

    pieces = examples.coalesce(1).sortWithinPartitions("y", F.xxhash64("id"), "id").mapInArrow(build, "i bigint, data binary")
    return Pickled([bytes(r["data"]) for r in materialise(pieces, "index").orderBy("i").toLocalIterator()])


def _fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id",
         text_col: str = "text", label_col: str = "toxic", per_class: int = EXAMPLES) -> tuple[Index | Pickled, DataFrame]:
    labelled = labels.select(F.col(id_col).alias("lid"), F.col(label_col).alias("y")).filter(
        F.col("lid").isNotNull() & F.col("y").isin(0, 1))
    labelled = labelled.groupBy("lid").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
    labelled = labelled.select("lid", F.col("y").cast("int").alias("y")).filter(F.lit(True) if train is None else train)
    keys = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).filter("id is not null")
    rows = materialise(labelled.join(keys, F.col("id") == F.col("lid")).groupBy("id", "y").agg(F.min("key").alias("key")), "training")
    total = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    if len(total) < 2:
        return build_index([], [], [], [], {}, 0, share), materialise(_counted(docs, np.zeros(0, np.int64), id_col, text_col), "term-counts")
    pick = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    examples = _example_terms(docs, materialise(pick[0].unionByName(pick[1]), "examples"), id_col, text_col)
    vocabulary = np.sort(examples.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].to_numpy())
    counted = materialise(_counted(docs, vocabulary, id_col, text_col), "term-counts")
    return _built(examples, vocabulary, _frequency(counted, len(vocabulary)), total, counted.count(), share), counted


def fit(docs: DataFrame, labels: DataFrame, **options) -> tuple[Index, DataFrame]:
    """The index, and the term counts of all documents.  Option ``train``: a
    condition on the label's id, ``lid``."""
    index, counted = _fit(docs, labels, **options)
    if isinstance(index, Pickled):
        index = _load(index.parts)
        index.invert()
    return index, counted


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key``, ``score`` and the evidence,
    ids and cosines of the neighbours.  Options as in ``fit``."""
    index, counted = _fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.ready()
        place = {id_: i for i, id_ in enumerate(index.ids.tolist())}
        for batch in small_batches(batches):
            scores, near, cosines = [], [], []
            vectors = [index.vector(_unpacked(found)) for found in batch.column(2).to_pylist()]
            # A document that is an example leaves itself out.
            for i, c in index.search(vectors, without=[place.get(x) for x in batch.column(0).to_pylist()]):
                scores.append(min(1.0, max(0.0, index.score(index.vote(i, c)))))
                near.append([int(x) for x in index.ids[i]])
                cosines.append(c.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())),
                 pa.array(cosines, pa.list_(pa.float64()))], names=["id", "key", "score", "neighbours", "cosines"])

    id_type = counted.schema["id"].dataType.simpleString()
    return counted.mapInArrow(run, f"id {id_type}, key bigint, score double, neighbours array<bigint>, cosines array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``.
    Rows leave by id and text together."""
    scored = score_documents(docs, labels, text_col=text_col, **options)
    bad = materialise(scored.filter(F.col("score") >= threshold).select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(),
                      "toxic-texts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(options.get("id_col", "doc_id")).alias("id"),
                       text_key(F.col(text_col)).alias("key"))
    return rows.join(bad, (F.col("key") == F.col("bad_key")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
