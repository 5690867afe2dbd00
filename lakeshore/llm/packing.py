"""Order-preserving packing by dynamic programming.

Documents stay in input order.  Each input partition is a token stream (a
document: its ids, then an end id) that is cut into windows of at most
``width`` tokens; a window is padded to ``width`` unless its length is a power
of two.  Cuts may fall at the end of a document (free), at the end of a
sentence (``SENTENCE`` penalty) or, where neither occurs for long, inside a
sentence (``INSIDE`` penalty).  The cost of a packing is its padding plus its
penalties.  With f(j) the least cost up to place j, a window from i to j costs
width - (j - i), so f(j) = penalty(j) + width - j + min(f(i) + i) over the
places of the last ``width`` tokens: a sliding minimum that a monotone queue
gives in constant time, beside the windows of a half and a quarter of the width.

The stream is solved in pieces of ``HORIZON`` tokens (the last, unfinished
windows are carried on), so memory does not grow with the partition, and no
row is shuffled: partitions are packed side by side, each with a sequence
number space of its own.  The last window of a partition may be cut into
powers of two when that costs less than its padding.

Defined cases: null and empty texts are one end id; null ids and repeated rows
are documents like others; very long documents run over many windows; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import small_batches

WIDTH = 4096
END_ID = 2
#: Penalties in tokens of padding.
SENTENCE = 4
INSIDE = 64
#: Without an end of document or sentence for this many tokens, places inside a sentence are allowed.
GAP = 1024
#: Tokens solved at once.
HORIZON = 1 << 19
#: Words and parts of words whose ids a worker remembers, at most, in each of two generations.
CACHE = 400_000


class Memory(dict):
    """A bounded dictionary of two generations: when the new one is full it
    becomes the old one, and what is still used moves over."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def recall(self, key):
        if (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def keep(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


#: Latin-1 letters, lower case (no normalisation changes them): one pre-token;
#: then marks without apostrophe and digits: one pre-token.
PLAIN_WORD = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


class WordTokenizer:
    """Ids of a text from remembered ids of its words.  Only for BPE tokenizers
    with word ends that lower-case, drop white space and let no token span it:
    a text's ids are those of its white-space separated words one after
    another.  Words of Latin letters and marks are split here and merged by the
    BPE model; all others take the tokenizer's own way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x21, 0x100))}
        self.words, self.parts = Memory(CACHE // 2), Memory(CACHE // 2)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.sentence = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            mark = token.removesuffix("</w>")
            if token.endswith("</w>") and mark and set(mark) <= set(".!?"):
                self.sentence[i] = True

    def part(self, text: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.parts.get(text) or self.parts.recall(text)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(text.translate(self.letters))], "<u4").tobytes()
            self.parts.keep(text, ids)
        return ids

    def word(self, word: bytes) -> bytes:
        ids = self.words.get(word) or self.words.recall(word)
        if ids is None:
            text = word.decode("utf-8")
            if m := PLAIN_WORD.fullmatch(text):
                ids = self.part(m[1]) + (self.part(m[2]) if m[2] else b"")
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            self.words.keep(word, ids)
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8").lower().split() if text else []
        ids = list(map(self.words.get, words))
        if None in ids:
            ids = [self.word(w) if i is None else i for w, i in zip(words, ids)]
        return np.frombuffer(b"".join(ids), "<u4")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _windows(place: np.ndarray, penalty: np.ndarray, width: int, last: bool) -> list[int]:
    """Indexes of the chosen cuts among ``place`` (increasing, from 0), without
    the first.  Unless ``last``, the best cut within the final ``width``
    tokens ends the plan and the rest is left over."""
    n = len(place)
    p, pen = place.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}        # windows of a large power of two below the width
    for k in (1 << b for b in range((width - 1).bit_length()) if width <= 4 << b and 1 << b < width):
        at = np.searchsorted(place, place - k)
        hit = np.flatnonzero((place >= k) & (place[at] == place - k))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            exact.setdefault(j, []).append(i)
    f = [0.0] * n
    back = [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        pj = p[j]
        low = pj - width
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = f[i] + p[i] + width - pj
        if j in exact:
            for e in exact[j]:
                if f[e] < best:
                    best, i = f[e], e
        f[j] = best + pen[j]
        back[j] = i
        g = f[j] + pj
        while queue and f[queue[-1]] + p[queue[-1]] >= g:
            queue.pop()
        queue.append(j)
    end = n - 1
    if not last:
        near = [j for j in range(n - 1, 0, -1) if p[j] > p[-1] - width]
        end = min(near, key=lambda j: (f[j], -j))
    cuts = []
    while end:
        cuts.append(end)
        end = back[end]
    return cuts[::-1]


def _places(flags: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream and their penalties: ``flags`` is 2 after the
    last token of a document, 1 after that of a sentence, else 0."""
    at = np.flatnonzero(flags) + 1
    pen = np.where(flags[at - 1] == 2, 0, SENTENCE)
    at, pen = np.concatenate(([0], at)), np.concatenate(([0], pen))
    ends = np.append(at[1:], len(flags))
    wide = np.flatnonzero(ends - at > gap)
    if len(wide):
        more = np.concatenate([np.arange(at[w] + gap // 2, ends[w], gap // 2) for w in wide])
        at, pen = np.concatenate((at, more)), np.concatenate((pen, np.full(len(more), INSIDE)))
    if at.max() < len(flags):
        at, pen = np.append(at, len(flags)), np.append(pen, INSIDE)
    order = np.argsort(at, kind="stable")
    at, pen = at[order], pen[order]
    once = np.concatenate(([True], at[1:] != at[:-1]))
    return at[once], pen[once]


def cut_stream(flags: np.ndarray, width: int = WIDTH, last: bool = True, gap: int | None = None) -> list[int]:
    """Ends of the windows of a stream, in tokens (see ``_places`` for
    ``flags``).  If not ``last``, the stream goes on and the end may be left over."""
    if not len(flags):
        return []
    place, penalty = _places(flags, min(gap or GAP, width))
    cuts = [int(place[i]) for i in _windows(place, penalty, width, last)]
    if last:
        start = cuts[-2] if len(cuts) > 1 else 0
        size = cuts[-1] - start
        ones = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
        if INSIDE * (len(ones) - 1) < (width - size if len(ones) > 1 else 0):
            cuts[-1:] = (start + np.cumsum(ones)).tolist()
    return cuts


def pack_stream(documents: Iterator[tuple[object, np.ndarray, np.ndarray]], width: int = WIDTH,
                horizon: int = HORIZON) -> Iterator[tuple]:
    """Pieces of a stream of (id, token ids, flags): (id, start, ids, document
    length, sequence, offset), sequences numbered from 0."""
    pending: deque[list] = deque()          # [id, ids, flags, taken so far]
    waiting = sequence = 0

    def solve(last: bool) -> Iterator[tuple]:
        nonlocal waiting, sequence
        flags = np.concatenate([d[2][d[3]:] for d in pending]) if pending else np.zeros(0, np.int8)
        start = 0
        while start < len(flags):
            piece = flags[start:start + horizon]
            end = last and start + horizon >= len(flags)
            if not end and len(piece) < horizon:
                break
            at = 0
            for cut in cut_stream(piece, width, end):
                offset = 0
                while offset < cut - at:
                    doc = pending[0]
                    take = min(len(doc[1]) - doc[3], cut - at - offset)
                    yield doc[0], doc[3], doc[1][doc[3]:doc[3] + take], len(doc[1]), sequence, offset
                    offset += take
                    doc[3] += take
                    if doc[3] == len(doc[1]):
                        pending.popleft()
                at = cut
                sequence += 1
            waiting -= at
            start += at

    for key, ids, flags in documents:
        pending.append([key, ids, flags, 0])
        waiting += len(ids)
        if waiting >= horizon:
            yield from solve(False)
    yield from solve(True)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
         end_id: int = END_ID, load: Callable[[str], WordTokenizer] = word_tokenizer) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``ids`` (little-endian unsigned
    32-bit), ``length``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"id {id_type}, start bigint, ids binary, length bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        first = TaskContext.get().partitionId() << 40

        def documents() -> Iterator[tuple]:
            for batch in small_batches(batches):
                for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                    ids = np.append(tokenizer(text), np.uint32(end_id)).astype("<u4")
                    flags = tokenizer.sentence[ids].astype(np.int8)
                    flags[-1] = 2
                    yield key, ids, flags

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            key, start, ids, total, sequence, offset = zip(*pieces)
            key_type = key[0].type
            return pa.RecordBatch.from_arrays([
                pa.array([k.as_py() for k in key], key_type), pa.array(start, pa.int64()),
                pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array(total, pa.int64()), pa.array([first + s for s in sequence], pa.int64()),
                pa.array(offset, pa.int64())],
                names=["id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])

        pieces: list[tuple] = []
        for piece in pack_stream(documents(), width):
            pieces.append(piece)
            if len(pieces) >= 2048:
                yield batch_of(pieces)
                pieces = []
        if pieces:
            yield batch_of(pieces)

    return rows.mapInArrow(run, schema)
