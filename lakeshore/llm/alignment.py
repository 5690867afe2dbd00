"""Alignment of two tokenizers over whole texts, and how often their ids are linked.

A text is read as a space followed by the text (the second tokenizer adds that
space itself).  Places in the bytes where tokens of both end cut them into
groups; tokens whose byte ranges overlap are linked.  An id pair's count is
the number of links in the whole corpus that hold it.

Byte ends come from the tokenizers' own spans: character offsets of the first,
protobuf spans of the second (sentencepiece's ``proto`` result, which has
taken the place of its ``immutable_proto``).  They are coarse: several tokens
of one multi-byte character share a span, and byte-fallback tokens have an
empty one.  A span is taken where it agrees with the token's decoded bytes;
elsewhere the end is the previous end plus the length of those bytes.

No token of either crosses from a visible character into a space or line feed,
or from a Latin letter into a mark of punctuation (checked on the files: the
first cuts words by its pattern, the second has no such piece), so a text's
tokens are those of its stretches, cut there, one after another.  Distinct
stretches are aligned together and remembered.  Tokenizers that fail the check
are refused.

Blocks of ``BLOCK`` bytes of text are written with their documents' stretches
and the distinct id pairs.  Pairs are counted by one aggregation over the
blocks' pairs; each block then asks for the counts of its own pairs, so no
count table is ever whole in one place.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from space and text (U+2581, which the second reads as a space), have no
tokens: zeros and an empty string; they link nothing.  Null ids and repeated
rows are documents like others; very long texts are a block of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import materialise, small_batches
from lakeshore.llm.packing import Memory

#: Bytes of text per block.
BLOCK = 8 << 20
#: Remembered stretches per worker, and the longest one in characters.
CACHE, LONGEST = 300_000, 64
_LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Between a visible character and a space or line feed.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


class Stretch(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: str                     # "a1,a2|b1;a3|b2"
    links: bytes                    # a << 32 | b as 64-bit numbers, one per link


NONE = Stretch(0, 0, 0, "", b"")


def byte_ends(start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ends of consecutive tokens from coarse byte spans, refined by the
    ``size`` of their decoded bytes: a span that is as long as the token and
    starts where the one before ended is a sure cut; the ends after it are
    counted on from it."""
    counted = np.cumsum(size)
    sure = (end - start == size) & (start == counted - size)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    return np.where(last >= 0, end[last] + counted - counted[last], counted)


def link(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two token sequences over the same bytes: the links in order, where
    each ends, and the ends that both share.  Between two neighbouring ends of
    either lies one token of each, and two tokens overlap in one such piece."""
    ends = np.union1d(ends_a, ends_b)
    links = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]
    return links, ends, np.intersect1d(ends_a, ends_b, assume_unique=True)


class Aligner:
    """``path_a``: a ``tokenizers`` file with byte-level tokens; ``path_b``: a
    ``sentencepiece`` model with byte fallback that adds a space in front."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        # Byte-level tokens write a visible byte as that Latin-1 character and the n-th other one as U+0100 + n.
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        letters = {chr(x): x for x in visible} | {chr(0x100 + n): x for n, x in enumerate(sorted({*range(0x100)} - visible))}
        self.bytes_a = {i: bytes(letters.get(x, ord("?")) for x in token) for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a[i]) for i in range(len(self.bytes_a))])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        if not self._by_words() or any(re.search(r"[^\s▁][▁ \n]|.\n|\n.", p, re.S) for p in pieces):
            raise ValueError("tokens of these tokenizers may cross from a visible character into a space")
        # Marks that no piece of the second holds after a Latin letter; the first always cuts there.
        marks = "".join(m for m in ".,!?;:" if not any(re.search(f"{_LATIN}{re.escape(m)}", p) for p in pieces))
        word = f"[ \n]*{_LATIN}+(?=[{marks}])|" if marks else ""
        self.stretch = re.compile(word + r"[ \n]*[^ \n]+|[ \n]+")
        self.memory = Memory(CACHE)

    def _by_words(self) -> bool:
        """Whether the first cuts its text by the usual byte-level pattern, and neither changes characters."""
        import json

        from sentencepiece import sentencepiece_model_pb2 as pb
        spec = json.loads(self.a.to_str())
        first = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        model = pb.ModelProto.FromString(self.b.serialized_model_proto())
        second = not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces
        return first and spec["pre_tokenizer"].get("use_regex", True) and second

    def stretches(self, text: str) -> list[str]:
        """Space and text, cut where no token of either crosses."""
        return _CUT.split(" " + text) if _OTHER_SPACE.search(text) else self.stretch.findall(" " + text)

    def align(self, stretches: list[str]) -> list[Stretch | None]:
        """The alignment of each; None where the joined bytes differ."""
        if not stretches:
            return []
        # The second puts a space of its own in front: with a line feed behind it, it stays apart and goes again.
        first = self.a.encode_batch(stretches, add_special_tokens=False)
        second = [y.pieces for y in self.b.encode(["\n" + s for s in stretches], return_type="proto", num_threads=1)]
        n_a, n_b = [len(x) for x in first], [len(y) - 2 for y in second]
        a = np.empty((sum(n_a), 3), np.int64)
        a[:, 0] = np.fromiter(chain.from_iterable([x.ids for x in first]), np.int64, len(a))
        a[:, 1:] = np.fromiter(chain.from_iterable(chain.from_iterable([x.offsets for x in first])), np.int64, 2 * len(a)).reshape(-1, 2)
        b = np.array([(p.id, p.begin, p.end) for y in second for p in y[2:]], np.int64).reshape(-1, 3)
        # Spans as places in the bytes of the joined stretches.
        whole = "".join(stretches)
        raw = whole.encode()
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        place = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))))
        chars = np.cumsum([0, *map(len, stretches)])
        a[:, 1:] = place[a[:, 1:] + np.repeat(chars[:-1], n_a)[:, None]]
        b[:, 1:] += np.repeat(place[chars[:-1]] - 1, n_b)[:, None]
        if (b"".join(map(self.bytes_a.__getitem__, a[:, 0].tolist())) != raw
                or b"".join(map(self.bytes_b.__getitem__, b[:, 0].tolist())) != raw):
            half = len(stretches) // 2
            return self.align(stretches[:half]) + self.align(stretches[half:]) if half else [None]
        ends_a, ends_b = (byte_ends(x[:, 1], x[:, 2], size[x[:, 0]]) for x, size in ((a, self.size_a), (b, self.size_b)))
        links, ends, common = link(a[:, 0], ends_a, b[:, 0], ends_b)
        # All groups as text at once: their ids in order, and what stands after each.
        group = np.concatenate((np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)))
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = np.concatenate((a[:, 0], b[:, 0]))[order], group[order], side[order]
        limits = place[chars[1:]]
        after = np.append((group[1:] != group[:-1]) * 2 + (side[1:] != side[:-1]) * (group[1:] == group[:-1]), 2)
        after[np.searchsorted(group, np.searchsorted(common, limits), side="right") - 1] = 3
        text = "".join(chain.from_iterable(zip(map(str, ids.tolist()), map(",|;\n".__getitem__, after.tolist())))).split("\n")
        cut_a, cut_b, cut_groups, cut_links = (
            [0, *np.searchsorted(x, limits, side="right").tolist()] for x in (ends_a, ends_b, common, ends))
        packed = links.tobytes()
        return [Stretch(cut_a[k + 1] - cut_a[k], cut_b[k + 1] - cut_b[k], cut_groups[k + 1] - cut_groups[k], text[k],
                        packed[8 * cut_links[k]:8 * cut_links[k + 1]]) for k in range(len(stretches))]

    def recall(self, stretches: list[str]) -> list[Stretch | None]:
        """``align`` of distinct stretches, remembering those of usual length."""
        found = list(map(self.memory.get, stretches))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.memory.recall(stretches[i])
        new = [i for i, x in enumerate(found) if x is None]
        for start in range(0, len(new), 4096):
            some = new[start:start + 4096]
            for i, x in zip(some, self.align([stretches[i] for i in some])):
                found[i] = x
                if x is not None and len(stretches[i]) <= LONGEST:
                    self.memory.keep(stretches[i], x)
        return found


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers below 2**32, byte by byte in planes."""
    head = np.array([len(x) for x in arrays], "<u8").tobytes()
    body = np.concatenate(arrays).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return bytes([len(arrays)]) + head + zlib.compress(body, 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = data[0]
    sizes = np.frombuffer(data, "<u8", n, 1).astype(np.int64)
    planes = np.frombuffer(zlib.decompress(data[1 + 8 * n:]), np.uint8).reshape(4, -1)
    return np.split(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64), np.cumsum(sizes)[:-1])


def _starts(sizes: Iterable[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(sizes, np.int64))))


def _ranges(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of ranges ``at`` of ``starts``, one after another."""
    n = starts[at + 1] - starts[at]
    return np.arange(n.sum()) + np.repeat(starts[at] - np.cumsum(n) + n, n)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the consecutive ranges of ``values``, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def align_block(ids: pa.Array, texts: list[str | None], aligner: Aligner, digest: bool) -> dict:
    """One block: its documents' figures, their stretches, the stretches' pairs."""
    lists = [aligner.stretches(t) if t else [] for t in texts]
    number = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
    found = aligner.recall(list(number))
    sound = np.array([x is not None for x in found], bool)
    found = [x or NONE for x in found]
    sizes = np.array([(x.n_a, x.n_b, x.n_groups, len(x.links) // 8) for x in found], np.int64).reshape(-1, 4)
    text_of = [x.groups for x in found]
    weight = np.zeros(len(found), np.int64)
    figures, groups, words, counts = [], [], [], []
    for stretches in lists:
        at = np.fromiter(map(number.__getitem__, stretches), np.int64, len(stretches))
        if not len(at) or not sound[at].all():
            at = at[:0]
        figures.append(sizes[at].sum(axis=0))
        joined = ";".join(map(text_of.__getitem__, at.tolist()))
        groups.append(hashlib.sha256(joined.encode()).hexdigest() if digest and len(at) else joined)
        distinct, n = np.unique(at, return_counts=True)
        weight[distinct] += n
        words.append(distinct)
        counts.append(n)
    use = weight > 0                        # the others stand in texts without tokens only
    links = [x.links for x, u in zip(found, use) if u]
    n_links = np.where(use, sizes[:, 3], 0)
    pairs, place = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    n = np.bincount(place, np.repeat(weight, n_links), len(pairs)).astype(np.int64) if len(pairs) else place
    figures = np.array(figures, np.int64).reshape(-1, 4)
    table = pa.table([ids, *[pa.array(figures[:, i]) for i in range(4)], pa.array(groups, pa.string())],
                     names=["id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    zero = np.zeros(0, np.int64)
    return {"docs": sink.getvalue().to_pybytes(),
            "body": _packed(np.array([len(x) for x in words], np.int64), np.concatenate([zero, *[np.diff(x, prepend=0) for x in words]]),
                            np.concatenate([zero, *counts]), n_links, place),
            "pairs": zlib.compress(np.diff(pairs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1),
            "n": zlib.compress(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)}


def _longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def score_block(docs: bytes, body: bytes, total: np.ndarray, top: np.ndarray) -> pa.Table:
    """The documents of a block with ``n_best`` and ``count_sum``; ``total``
    and ``top``: count of each of its pairs, and whether it is the highest of its second id."""
    table = pa.ipc.open_stream(docs).read_all()
    n_words, steps, counts, n_links, place = _unpacked(body)
    starts = _starts(n_words)
    run = np.cumsum(steps)
    base = np.concatenate(([0], run))[starts[:-1]]
    words = run - np.repeat(base, n_words)
    link_starts = _starts(n_links)
    for name, values in (("n_best", top.astype(np.int64)), ("count_sum", total)):
        each = _sums(values[place], link_starts) if len(place) else np.zeros(len(n_links), np.int64)
        table = table.append_column(name, pa.array(_sums(counts * each[words], starts)))
    return table


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
          block: int = BLOCK, load: Callable[[str, str], Aligner] = aligner) -> DataFrame:
    """One row per document: ``id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups`` (the ids of each group, or the SHA-256 of that text
    if ``digest``), ``n_best`` and ``count_sum``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, first = load(path_a, path_b), TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        size = done = 0

        def written() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            out = align_block(table.column(0).combine_chunks(), table.column(1).to_pylist(), tokenizers, digest)
            return pa.RecordBatch.from_pylist([{"block": first + done, **out}], pa.schema(
                [("block", pa.int64()), ("docs", pa.binary()), ("body", pa.binary()), ("pairs", pa.binary()), ("n", pa.binary())]))

        for batch in small_batches(batches, 64):
            # Buffers of a slice are those of its whole batch.
            lengths = pa.compute.sum(pa.compute.binary_length(batch.column(1))).as_py() or 0
            if parts and size + lengths > block:
                yield written()
                parts, size, done = [], 0, done + 1
            parts.append(batch)
            size += lengths
        if parts:
            yield written()

    blocks = materialise(rows.mapInArrow(cut, "block bigint, docs binary, body binary, pairs binary, n binary"), "aligned")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            pairs, n = np.cumsum(_longs(batch.column(1)[0].as_py())), _longs(batch.column(2)[0].as_py())
            for start in range(0, len(pairs), 1 << 16):
                some = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[some]), batch.column(0)[0].as_py())),
                                                  pa.array(np.arange(len(pairs))[some].astype(np.int32)), pa.array(pairs[some]), pa.array(n[some])],
                                                 names=["block", "place", "pair", "n"])

    pairs = blocks.select("block", "pairs", "n").mapInArrow(spread, "block bigint, place int, pair bigint, n bigint")
    totals = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = totals.groupBy(second.alias("b")).agg(F.max("total").alias("most"))
    counted = totals.join(most, second == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("top"))
    answers = pairs.join(counted, "pair").select("block", "place", "total", "top")

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy(), kind="stable")
        parts = [score_block(docs, body, right.column("total").to_numpy()[order], right.column("top").to_numpy(zero_copy_only=False)[order])
                 for docs, body in zip(left.column("docs").to_pylist(), left.column("body").to_pylist())]
        return pa.concat_tables(parts)

    return blocks.select("block", "docs", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint")
