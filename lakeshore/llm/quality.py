"""Quality classifier: perplexity under an interpolated modified Kneser-Ney
trigram model of trusted text.

Trusted text is that of the documents labelled good, equal texts once.  Four
fifths of it, by the hash of the id, train, all of them and whole; the others
set the thresholds.  (A caller may bound the training text with ``documents``
and ``words``, see ``training_sample``; by default nothing is bounded.)

The model grows with the input, so it stays sharded.  Documents are dealt into
blocks of about ``BLOCK`` bytes, and all words get numbers.  A block sends its
distinct trigrams, with their training counts, to the shard of their first two
words; a shard adds up equal ones, answers with the counts of trigrams and
contexts in the same order, and passes the distinct trigrams on as
continuation counts of pairs, which pass on those of words in the same way.
All n-grams take their turn in ``PASSES`` passes, trigrams and pairs by their
middle word and first word, which are the same: what a pass has shuffled and
passed on is gone before the next begins.  Numbers of words follow their
frequency, nearly, so most take few bytes.
The block then holds the counts of exactly the n-grams that its texts can
reach, and scores them; the discounts follow from counts of counts.  Tokens
are words with A-Z lower-cased, then one end; words outside the model share
one unknown word.

A document is kept when its perplexity is at most the ``QUANTILE`` of the held
out trusted documents of its language; a language with fewer than ``ENOUGH`` of
these takes the quantile of all.

Defined cases: null text counts as empty (the end token alone); a null or
unknown language takes the threshold of all; a label row counts if its label is
1 and its id is not null; without trusted text every document is kept and the
threshold is null; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import WORD, discard, lower_words, materialise, text_key, text_or_empty
from lakeshore.llm.lm_scoring import _deal, _documents, _mix

#: Text bytes of a block, about, and blocks per shard of the counts.
BLOCK = 6 << 20
BLOCKS_PER_SHARD = 2
#: Parts of the n-grams, and of the blocks to score, that are under way at a time.
PASSES = 4
QUANTILE = 0.99
ENOUGH = 20
#: In a bounded training text no document has more than this part of the words.
PART = 50
BEGIN, END = 1, 2       # in place of a word's hash


def _hash(word: bytes) -> int:
    """A word as a positive long above the two marks."""
    return (xxhash.xxh64_intdigest(word) >> 1) | 4


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 and more (index 0 unused)."""
    return _discounts_of([int((counts == i).sum()) for i in range(5)])


def _discounts_of(n: list[int]) -> np.ndarray:
    """The discounts from how often each count occurs."""
    out = [0.0]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else 0.75
        out.append(min(max(d, 0.1), i - 0.05))
    return np.array(out)


def _order(group: np.ndarray, counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For one order: (count - discount) / total of the group, and the group's
    interpolation weight (1 for a group without counts)."""
    discount = _discounts(counts)[np.minimum(counts, 3)]
    total = np.bincount(group, counts, groups)
    share = (counts - discount) / total[group]
    weight = np.where(total > 0, np.bincount(group, discount, groups) / np.maximum(total, 1), 1.0)
    return share.astype(np.float32), weight


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted ``keys``, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """The model in one piece, for small texts.  Sorted n-gram keys over word numbers (place in ``words``; their count is the unknown word)."""
    words: np.ndarray
    p1: np.ndarray
    pairs: np.ndarray           # second word's order: word * size + word
    share2: np.ndarray
    weight2: np.ndarray         # by word
    contexts: np.ndarray
    weight3: np.ndarray         # by context
    triples: np.ndarray         # context * size + word
    share3: np.ndarray

    @classmethod
    def fit(cls, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> Model:
        """From distinct trigrams of word hashes and their counts."""
        words = np.unique(np.concatenate((a, b, c)))
        a, b, c = (np.searchsorted(words, x) for x in (a, b, c))
        size = len(words) + 1
        contexts, context = np.unique(a * size + b, return_inverse=True)
        triples = context * size + c
        order = np.argsort(triples)
        share3, weight3 = _order(context[order], n[order], len(contexts))
        pairs, before = np.unique(b * size + c, return_counts=True)           # distinct words before each pair
        share2, weight2 = _order(pairs // size, before, size)
        last, kinds = np.unique(pairs % size, return_counts=True)             # distinct words before each word
        share1, weight1 = _order(np.zeros(len(last), np.int64), kinds, 1)
        p1 = np.full(size, (weight1[0] if len(last) else 1.0) / size)
        p1[last] += share1
        return cls(words, p1, pairs, share2, weight2, contexts, weight3, triples[order], share3)

    def log10(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text, given as word hashes without the end."""
        size = len(self.words) + 1
        lengths = np.array([len(h) + 1 for h in hashes], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.full(starts[-1], END, np.int64)
        for h, s in zip(hashes, starts):
            flat[s:s + len(h)] = h
        distinct, place = np.unique(flat, return_inverse=True)
        known = _find(self.words, distinct)
        w = np.where(known < 0, size - 1, known)[place]
        begin = int(np.searchsorted(self.words, BEGIN))
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], u[2:] = w[:-1], w[:-2]
        v[starts[:-1]] = u[starts[:-1]] = begin
        second = starts[:-1][lengths > 1] + 1
        u[second] = begin
        at2 = _find(self.pairs, v * size + w)
        p = np.where(at2 >= 0, self.share2[at2], 0) + self.weight2[v] * self.p1[w]
        context = _find(self.contexts, u * size + v)
        at3 = np.where(context >= 0, _find(self.triples, context * size + w), -1)
        p3 = np.where(at3 >= 0, self.share3[at3], 0) + self.weight3[context] * p
        return np.add.reduceat(np.log10(np.where(context >= 0, p3, p)), starts[:-1])


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    words = [lower_words(t or "") for t in texts]
    number = {w: _hash(w) for w in set().union(*words)} if words else {}
    return [np.array([number[w] for w in ws], np.int64) for ws in words]


LOW = np.uint64(0xFFFFFFFF)


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, as many as the largest needs, compressed."""
    x = numbers.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return width.to_bytes(1) + len(x).to_bytes(5) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:6])
    out = np.zeros((n, 8), np.uint8)
    raw = pa.decompress(data[6:], decompressed_size=width * n, codec="zstd", asbytes=True)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _pack_rising(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def _unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each shard, in their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[places[0]]), places) for places in np.split(order, cuts) if len(places)]


#: Messages between blocks and shards: packed columns, one row each.
MESSAGE = "kind int, target bigint, source bigint, data array<binary>"
ASK, TRIPLES, PAIRS, WORDS, PASSED, SPECTRUM = range(6)


def _messages(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.Table:
    kind, target, source, data = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "target": pa.array(target, pa.int64()),
                     "source": pa.array(source, pa.int64()), "data": pa.array(data, pa.list_(pa.binary()))})


def _spectrum(order: int, counts: np.ndarray) -> tuple[int, int, int, list[bytes]]:
    """How many n-grams of an order have count 1, 2, 3 and 4; how many there are; their sum."""
    n = [int((counts == i).sum()) for i in range(1, 5)]
    return SPECTRUM, -1, order, [np.array([*n, len(counts), counts.sum()], np.int64).tobytes()]


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts).astype(float), len(distinct)).astype(np.int64)


def _ones_twos_more(group: np.ndarray, counts: np.ndarray, groups: int) -> list[np.ndarray]:
    """Per group the sum of its counts, and how many of them are 1, 2 and more."""
    few = np.minimum(counts, 3)
    return [np.bincount(group, counts.astype(float), groups).astype(np.int64),
            *(np.bincount(group[few == i], minlength=groups) for i in (1, 2, 3))]


def _words_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words % np.uint64(shards)).astype(np.int64)


def _pass(words: np.ndarray) -> np.ndarray:
    return (_mix(words) % np.uint64(PASSES)).astype(np.int64)


def _shard(pairs: np.ndarray, middle: np.ndarray, shards: int) -> np.ndarray:
    """A shard of the pass of each pair's middle word; every pass has its own shards."""
    each = max(1, shards // PASSES)
    return _pass(middle) * each + (_mix(pairs) % np.uint64(each)).astype(np.int64)


def _contexts_shard(contexts: np.ndarray, shards: int) -> np.ndarray:
    return _shard(contexts, contexts & LOW, shards)


def _pairs_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return _shard(pairs, pairs >> np.uint64(32), shards)


class Block:
    """Texts of a block as distinct n-grams of word numbers (``BEGIN`` and
    ``END`` among them); a pair's code is its first word's number and, in the
    low half, the second's."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.words, place = np.unique(np.concatenate(([np.uint64(BEGIN)], tokens)), return_inverse=True)
        begin, self.word = place[0], place[1:]
        self.before = np.concatenate(([begin], self.word[:-1]))
        self.before[self.starts] = begin
        # Every context but the one of two beginnings is the pair of the token before.
        size = len(self.words)
        codes, place = np.unique(np.concatenate(([begin * size + begin], self.before * size + self.word)), return_inverse=True)
        self.pairs = (self.words[codes // size] << np.uint64(32)) | self.words[codes % size]
        begin, self.pair = place[0], place[1:]
        self.context = np.concatenate(([begin], self.pair[:-1]))
        self.context[self.starts] = begin
        triples, self.triple = np.unique(self.context * len(codes) + self.pair, return_inverse=True)
        self.contexts, self.fan = np.unique(triples // len(codes), return_counts=True)
        self.last = self.pairs[triples % len(codes)] & LOW

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(_unpack(row["tokens"]), _unpack(row["lengths"]).astype(np.int64))

    def by_context(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per shard the places of its contexts, and of their trigrams, in one order."""
        shard = _contexts_shard(self.pairs[self.contexts], shards)
        triples = dict(_by_shard(np.repeat(shard, self.fan)))
        for s, places in _by_shard(shard):
            yield s, places, triples[s]


class Turn:
    """The tokens of a block before which a word of pass ``turn`` stands."""

    def __init__(self, row: dict, turn: int):
        tokens, lengths = _unpack(row["tokens"]), _unpack(row["lengths"]).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        before = np.concatenate(([np.uint64(BEGIN)], tokens[:-1]))
        before[starts] = BEGIN
        first = np.concatenate(([np.uint64(BEGIN)], before[:-1]))
        first[starts] = BEGIN
        mine = np.flatnonzero(_pass(before) == turn)
        self.first, self.before, self.word = first[mine], before[mine], tokens[mine]
        self.learnt = np.repeat(_unpack(row["learnt"]).astype(bool), lengths)[mine]

    def triples(self, shards: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Per shard its contexts, how many trigrams each has, their last words and training counts; in ``by_context``'s order."""
        contexts, place = np.unique((self.first << np.uint64(32)) | self.before, return_inverse=True)
        triples, triple = np.unique((place.astype(np.uint64) << np.uint64(32)) | self.word, return_inverse=True)
        fan = np.bincount((triples >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
        last = triples & LOW
        counts = np.bincount(triple[self.learnt], minlength=len(triples))
        shard = _contexts_shard(contexts, shards)
        at = dict(_by_shard(np.repeat(shard, fan)))
        for s, places in _by_shard(shard):
            yield s, [contexts[places], fan[places], last[at[s]], counts[at[s]]]

    def pairs(self, turn: int) -> np.ndarray:
        """Distinct pairs; with the two beginnings, as ``Block`` has them."""
        begin = np.full(int(_pass(np.array([BEGIN], np.uint64))[0] == turn), BEGIN << 32 | BEGIN, np.uint64)
        return np.unique(np.concatenate((begin, (self.before << np.uint64(32)) | self.word)))


def _answer_triples(table: pa.Table, shards: int) -> pa.Table:
    asked = [(b, [_unpack_rising(d[0]), *map(_unpack, d[1:])])
             for b, d in zip(table.column("source").to_pylist(), table.column("data").to_pylist())]
    shard = table.column("target")[0].as_py()
    contexts, place = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
    cuts = np.cumsum([len(a[0]) for _, a in asked])[:-1]
    places = np.split(place, cuts)
    keys = [(np.repeat(p, a[1].astype(np.int64)).astype(np.uint64) << np.uint64(32)) | a[2] for p, (_, a) in zip(places, asked)]
    triples, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, np.concatenate([a[3] for _, a in asked]).astype(float), len(triples)).astype(np.int64)
    trained, counts = triples[n > 0], n[n > 0]
    context = (trained >> np.uint64(32)).astype(np.int64)
    sums = _ones_twos_more(context, counts, len(contexts))
    answers = np.split(n[place], np.cumsum([len(k) for k in keys])[:-1])
    out = [(TRIPLES, b, shard, [_pack(x) for x in (answer, *(s[p] for s in sums))])
           for (b, _), answer, p in zip(asked, answers, places)]
    # Each distinct trigram is one word before its last pair.
    pairs, before = np.unique(((contexts[context] & LOW) << np.uint64(32)) | (trained & LOW), return_counts=True)
    for s, at in _by_shard(_pairs_shard(pairs, shards)):
        out.append((PASSED, s, shard, [_pack_rising(pairs[at]), _pack(before[at])]))
    return _messages([*out, _spectrum(3, counts)])


def _asked_and_passed(table: pa.Table) -> tuple[list, list]:
    rows = table.to_pylist()
    return [r for r in rows if r["kind"] == ASK], [[_unpack_rising(r["data"][0]), *map(_unpack, r["data"][1:])]
                                                   for r in rows if r["kind"] == PASSED]


def _answer_pairs(table: pa.Table, shards: int) -> pa.Table:
    asked, passed = _asked_and_passed(table)
    shard = table.column("target")[0].as_py()
    pairs, before = _add([p[0] for p in passed], [p[1] for p in passed])
    out = []
    for r in asked:
        at = _find(pairs, _unpack_rising(r["data"][0]))
        out.append((PAIRS, r["source"], shard, [_pack(np.where(at >= 0, np.append(before, 0)[at], 0))]))
    first, group = np.unique(pairs >> np.uint64(32), return_inverse=True)
    sums = _ones_twos_more(group, before, len(first))
    words, group = np.unique(np.concatenate((first, pairs & LOW)), return_inverse=True)
    # Per word: as the first of pairs, the sum of their counts and how many are 1, 2, more; as the second, how many.
    columns = [np.zeros(len(words), np.int64) for _ in sums]
    for column, s in zip(columns, sums):
        column[group[:len(first)]] = s
    kinds = np.bincount(group[len(first):], minlength=len(words))
    for s, at in _by_shard(_words_shard(words, shards)):
        out.append((PASSED, s, shard, [_pack_rising(words[at]), *(_pack(c[at]) for c in (*columns, kinds))]))
    return _messages([*out, _spectrum(2, before)])


def _answer_words(table: pa.Table) -> pa.Table:
    asked, passed = _asked_and_passed(table)
    shard = table.column("target")[0].as_py()
    sums = [_add([p[0] for p in passed], [p[i] for p in passed]) for i in range(1, 6)]
    words = sums[0][0]
    out = []
    for r in asked:
        at = _find(words, _unpack_rising(r["data"][0]))
        out.append((WORDS, r["source"], shard, [_pack(np.where(at >= 0, np.append(s, 0)[at], 0)) for _, s in sums]))
    kinds = sums[4][1]
    return _messages([*out, _spectrum(1, kinds[kinds > 0])])


class Weights:
    """Discounts and totals of the three orders, from their spectra."""

    def __init__(self, spectra: dict[int, np.ndarray]):
        self.discount = {o: _discounts_of([0, *map(int, s[:4])]) for o, s in spectra.items()}
        n1, n2, _, _, self.distinct, self.total = map(int, spectra[1])
        d = self.discount[1]
        self.spare = (d[1] * n1 + d[2] * n2 + d[3] * (self.distinct - n1 - n2)) / max(self.total, 1)
        self.size = self.distinct + 2                   # with the beginning and the unknown word

    def share(self, order: int, counts: np.ndarray, totals) -> np.ndarray:
        kept = counts - self.discount[order][np.minimum(counts, 3)]
        return np.where(counts > 0, kept / np.maximum(totals, 1), 0.0)

    def weight(self, order: int, totals: np.ndarray, *few: np.ndarray) -> np.ndarray:
        mass = sum(d * n for d, n in zip(self.discount[order][1:], few))
        return np.where(totals > 0, mass / np.maximum(totals, 1), 1.0)


def _log10(block: Block, answers: list[dict], weights: Weights, shards: int) -> np.ndarray:
    """Log10 probability of each text of the block."""
    got = {(r["kind"], r["source"]): [_unpack(d).astype(np.int64) for d in r["data"]] for r in answers}
    n = np.zeros(len(block.last), np.int64)
    contexts = np.zeros((4, len(block.pairs)), np.int64)
    for s, places, triples in block.by_context(shards):
        n[triples], *sums = got[TRIPLES, s]
        contexts[:, block.contexts[places]] = sums
    pairs = np.zeros(len(block.pairs), np.int64)
    for s, places in _by_shard(_pairs_shard(block.pairs, shards)):
        pairs[places] = got[PAIRS, s][0]
    words = np.zeros((5, len(block.words)), np.int64)
    for s, places in _by_shard(_words_shard(block.words, shards)):
        words[:, places] = got[WORDS, s]
    p1 = weights.share(1, words[4], weights.total) + weights.spare / weights.size
    p2 = weights.share(2, pairs[block.pair], words[0][block.before]) + weights.weight(2, *words[:4])[block.before] * p1[block.word]
    p3 = weights.share(3, n[block.triple], contexts[0][block.context]) + weights.weight(3, *contexts)[block.context] * p2
    return np.add.reduceat(np.log10(p3), block.starts)


def _per_row(make: Callable[[dict], pa.Table]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make(batch.slice(i, 1).to_pylist()[0]).to_batches()
    return run


def _numbered(rows: DataFrame, trained: DataFrame, blocks: int, shards: int) -> DataFrame:
    """The documents by block, one row each: ``meta`` (``id``, ``key``,
    ``lang`` as an Arrow stream) and packed ``lengths``, ``learnt``, ``tokens``
    (word numbers).  ``rows`` and ``trained`` have ``row_key``; of repeated
    rows one is learnt."""
    def deal(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.pmod("row_key", F.lit(blocks)))

    def hashed(words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, and the place of each word's."""
        return np.unique(np.fromiter(map(_hash, words), np.uint64, len(words)), return_inverse=True)

    def ask(table: pa.Table) -> pa.Table:
        found = Counter(lower_words("\n".join(t or "" for t in _documents(table).column("text").to_pylist())))
        words, place = hashed(found)
        n = np.bincount(place, np.fromiter(found.values(), float, len(found)), len(words)).astype(np.int64)
        block = table.column("block")[0].as_py()
        return _messages([(ASK, s, block, [_pack_rising(words[at]), _pack(n[at])]) for s, at in _by_shard(_words_shard(words, shards))])

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("target")[0].as_py()
        asked = [(_unpack_rising(d[0]), _unpack(d[1])) for d in table.column("data").to_pylist()]
        words, n = _add([a[0] for a in asked], [a[1] for a in asked])
        # The commonest word of a shard comes first, and so has a small number.
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(words))
        return _messages([(WORDS, b, shard, [_pack(rank[np.searchsorted(words, a)] * shards + shard + END + 1)])
                          for b, (a, _) in zip(table.column("source").to_pylist(), asked)])

    def number(key, parts: pa.Table, other: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("block", pa.int64()), *((n, pa.binary()) for n in (
                "meta", "lengths", "learnt", "tokens")))})
        docs = _documents(parts)
        texts = [lower_words(t or "") for t in docs.column("text").to_pylist()]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        local: dict[bytes, int] = {}
        for w in chain.from_iterable(texts):
            local.setdefault(w, len(local))
        words, place = hashed(local)
        numbers = np.zeros(len(words), np.uint64)
        got = {r["source"]: r["data"][0] for r in other.filter(pc.is_valid(other.column("data"))).to_pylist()}
        for s, at in _by_shard(_words_shard(words, shards)):
            numbers[at] = _unpack(got[s])
        tokens = np.full(lengths.sum(), END, np.uint64)
        ends = np.cumsum(lengths)
        mine = np.ones(len(tokens), bool)
        mine[ends - 1] = False
        tokens[mine] = numbers[place][np.fromiter(map(local.__getitem__, chain.from_iterable(texts)), np.int64, mine.sum())]
        del texts, local
        row_keys = docs.column("row_key").to_numpy()
        _, first = np.unique(row_keys, return_index=True)
        learnt = np.zeros(len(row_keys), bool)
        learnt[first] = True
        learnt &= np.isin(row_keys, other.column("row_key").drop_null().to_numpy())
        sink = pa.BufferOutputStream()
        meta = docs.select(["id", "key", "lang"])
        with pa.ipc.new_stream(sink, meta.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(meta)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "meta": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                         **{name: pa.array([_pack(x)], pa.binary())
                            for name, x in (("lengths", lengths), ("learnt", learnt), ("tokens", tokens))}})

    parts = deal(rows).mapInArrow(_deal, "block bigint, part binary")
    numbers = parts.groupBy("block").applyInArrow(ask, MESSAGE).groupBy("target").applyInArrow(answer, MESSAGE)
    numbers = materialise(numbers.select(F.col("target").alias("block"), "source", "data", F.lit(None).cast("bigint").alias("row_key")),
                          "word-numbers")
    other = numbers.unionByName(deal(trained.select("row_key")), allowMissingColumns=True)
    out = materialise(parts.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(
        number, "block bigint, meta binary, lengths binary, learnt binary, tokens binary"), "blocks")
    discard(numbers)
    return out


def _trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid")).distinct()


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str,
                    documents: int, words: int) -> DataFrame:
    """``key``, ``text``, ``row_key``: a bounded sample of trusted documents, for callers who ask for one.
    Languages take turns, each in hash order; a document that is over
    ``words / PART`` words, or over what is left, is passed over whole."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(_trusted_ids(labels, id_col, label_col), F.col("id") == F.col("lid"))
    # Equal texts once.
    rows = rows.groupBy("key").agg(F.min("id").alias("id"), F.min("lang").alias("lang"))
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)) != 0)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "key"))
    pick = rows.withColumn("turn", turn).filter(F.col("turn") <= documents).orderBy("turn", "lang").limit(documents)
    pick = materialise(pick.select(F.col("key").alias("k"), F.col("id").alias("i"), F.col("lang").alias("l"), "turn"),
                       "trusted-keys")
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most ``documents`` rows from here on.
    rows = rows.join(F.broadcast(pick), (F.col("key") == F.col("k")) & (F.col("id") == F.col("i")))
    rows = rows.groupBy("key", "l", "turn").agg(F.first("text").alias("text"), F.first(F.xxhash64("id", "key")).alias("row_key"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(WORD)))
    rows = materialise(rows.filter(F.col("n") <= max(1, words // PART)), "trusted-candidates")
    # Numbers of at most ``documents`` rows.
    left, taken = words, []
    for r in rows.select("turn", "l", "n").orderBy("turn", "l").collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["turn"], r["l"]))
    chosen = rows.sparkSession.createDataFrame(taken, "t int, tl string")
    rows = rows.join(F.broadcast(chosen), (F.col("turn") == F.col("t")) & F.col("l").eqNullSafe(F.col("tl")))
    return materialise(rows.select("key", "text", "row_key"), "trusted")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``key``, ``row_key``: all trusted texts that train, equal ones once."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    rows = rows.join(_trusted_ids(labels, id_col, label_col), F.col("id") == F.col("lid"), "left_semi")
    rows = rows.groupBy("key").agg(F.min("id").alias("id"))
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(5)) != 0)
    return rows.select("key", F.xxhash64("id", "key").alias("row_key"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "quality", quantile: float = QUANTILE, documents: int | None = None, words: int | None = None,
          block_bytes: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``key``, ``lang``, ``n_tokens``,
    ``perplexity``, ``threshold``, ``kept``.  ``documents`` and ``words``,
    given together, bound the training text."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "key"))
    if documents is None or words is None:
        trained = materialise(training_rows(docs, labels, id_col, text_col, label_col), "trusted-keys")
    else:
        trained = training_sample(docs, labels, id_col, text_col, lang_col, label_col, documents, words)
    size = docs.agg(F.sum(F.octet_length(text_or_empty(F.col(text_col))))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    shards = max(1, blocks // BLOCKS_PER_SHARD)
    numbered = _numbered(rows, trained, blocks, shards)

    def ask_triples(row: dict, turn: int) -> pa.Table:
        return _messages([(ASK, s, row["block"], [_pack_rising(contexts), *map(_pack, more)])
                          for s, (contexts, *more) in Turn(row, turn).triples(shards)])

    def ask_pairs(row: dict, turn: int) -> pa.Table:
        pairs = Turn(row, turn).pairs(turn)
        return _messages([(ASK, s, row["block"], [_pack_rising(pairs[at])]) for s, at in _by_shard(_pairs_shard(pairs, shards))])

    def ask_words(row: dict, turn: int) -> pa.Table:
        words = np.unique(np.concatenate(([np.uint64(BEGIN)], _unpack(row["tokens"]))))
        return _messages([(ASK, s, row["block"], [_pack_rising(words[at])]) for s, at in _by_shard(_words_shard(words, shards))
                          if s % PASSES == turn])

    def asked(ask, turn: int) -> DataFrame:
        return numbered.mapInArrow(_per_row(lambda row: ask(row, turn)), MESSAGE)

    counts = []
    for turn in range(PASSES):
        triples = materialise(asked(ask_triples, turn).groupBy("target").applyInArrow(
            lambda t: _answer_triples(t, shards), MESSAGE), "trigram-counts")
        pairs = asked(ask_pairs, turn).unionByName(triples.filter(F.col("kind") == PASSED)).groupBy("target").applyInArrow(
            lambda t: _answer_pairs(t, shards), MESSAGE)
        counts.append(materialise(triples.filter(F.col("kind") != PASSED).unionByName(pairs), "pair-counts"))
        discard(triples)
    passed = reduce(DataFrame.unionByName, counts).filter(F.col("kind") == PASSED)
    for turn in range(min(PASSES, shards)):
        counts.append(materialise(asked(ask_words, turn).unionByName(passed.filter(F.col("target") % PASSES == turn)).groupBy(
            "target").applyInArrow(_answer_words, MESSAGE), "word-counts"))
    all_counts = reduce(DataFrame.unionByName, counts)
    spectra = {o: np.zeros(6, np.int64) for o in (1, 2, 3)}
    for r in all_counts.filter(F.col("kind") == SPECTRUM).toLocalIterator():        # six numbers a shard
        spectra[r["source"]] += np.frombuffer(bytes(r["data"][0]), np.int64)
    weights = Weights(spectra)

    def score(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block = Block.of(row)
        meta = pa.ipc.open_stream(row["meta"]).read_all()
        if weights.distinct:
            perplexity = pa.array(10.0 ** (-_log10(block, answers.to_pylist(), weights, shards) / block.lengths))
        else:
            perplexity = pa.nulls(len(block.lengths), pa.float64())
        return pa.table([*(c.combine_chunks() for c in meta.columns), pa.array(block.lengths), perplexity],
                        names=["id", "key", "lang", "n_tokens", "perplexity"])

    id_type = rows.schema["id"].dataType.simpleString()
    answers = all_counts.filter(F.col("kind").isin(TRIPLES, PAIRS, WORDS)).withColumnRenamed("target", "block")
    scored = reduce(DataFrame.unionByName, [
        materialise(numbered.filter(turn).groupBy("block").cogroup(answers.filter(turn).groupBy("block")).applyInArrow(
            score, f"id {id_type}, key bigint, lang string, n_tokens bigint, perplexity double"), "perplexity")
        for turn in (F.col("block") % PASSES == i for i in range(min(PASSES, blocks)))])
    for table in (numbered, *counts):
        discard(table)
    held = scored.join(_trusted_ids(labels, id_col, label_col), F.col("id") == F.col("lid"), "left_semi").join(
        trained.select("key"), "key", "left_anti")
    each = held.groupBy("key", "lang").agg(F.first("perplexity").alias("perplexity"))
    by_lang = each.filter("lang is not null").groupBy(F.col("lang").alias("l")).agg(
        F.percentile("perplexity", quantile).alias("of_lang"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ENOUGH)
    of_all = each.agg(F.percentile("perplexity", quantile)).first()[0]
    by_lang = {r["l"]: r["of_lang"] for r in by_lang.collect()}           # a row per language of the sample
    threshold = F.lit(of_all).cast("double")
    for lang, value in sorted(by_lang.items()):
        threshold = F.when(F.col("lang") == lang, value).otherwise(threshold)
    out = scored.withColumn("threshold", threshold)
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
