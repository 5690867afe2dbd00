"""Language-model scores by a weighted backoff automaton.

Tokens are the words of a text (A-Z lower-cased, ASCII white space between
them), then one end.  The model is a bigram model smoothed towards the
unigram: with c over all training tokens, N their number and V the distinct
ones, p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and
p(w | u) = (c(u w) + m p(w)) / (c(u) + m); the sum over all words and one
unknown word is 1.  As an automaton: a state for each context u, an arc
for each bigram u w with its smoothed probability, and for all else a failure
arc of weight m / (c(u) + m) to the root, whose arcs are p(w).  One
left-to-right traversal carries the state (the last token) and adds up the
logarithms.

Counts cover all training documents and stay sharded.  Documents are dealt
into blocks of about ``BLOCK`` bytes.  A block sends the hashes of its distinct
words and bigrams, with their training counts, to the shards (packed columns,
one row per block and shard); a shard adds up equal hashes and answers with the
totals in the same order; the block then holds exactly the part of the automaton
that its texts can reach, and traverses them.  So no count table is broadcast
or gathered whole, and a frequent word costs a shard one entry per block.

Defined cases: null text counts as empty (one end token); null ids have a fold
of their own value (the fold of the empty text); repeated rows are trained on
and scored like others; with no training documents every c is 0 and N, V are 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import lower_words, materialise, text_or_empty

#: Text bytes of a block, and of the documents per shard, about.
BLOCK = 6 << 20
#: Weight m of the unigram in a context.
WEIGHT = 20.0
END = 0         # token number of the end; also the context in which a text begins
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch by block, each block's part as one compressed
    stream: whole texts cross the network at a third of their size."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        table = pa.Table.from_batches([batch.take(pa.array(order))])
        cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
        numbers, parts = [], []
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(start, end - start))
                numbers.append(int(block[order[start]]))
                parts.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], names=["block", "part"])


def _documents(table: pa.Table) -> pa.Table:
    """The documents of a block's parts."""
    return pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in table.column("part").to_pylist())


class Block:
    """Texts of a block as token numbers, with its distinct words and bigrams."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[bytes, int] = {b"": END}
        tokens, lengths = [], []
        for text in texts:
            words = lower_words(text or "")
            tokens.append(np.array([numbers.setdefault(w, len(numbers)) for w in words] + [END], np.int64))
            lengths.append(len(words) + 1)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64) if tokens else self.lengths
        before = np.concatenate(([END], self.tokens[:-1])) if tokens else self.tokens
        if tokens:
            before[self.starts] = END
        self.states = before
        words = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
        pairs, self.arcs = np.unique(before * len(numbers) + self.tokens, return_inverse=True)
        self.pair_word = pairs % len(numbers)
        self.pair_state = pairs // len(numbers)
        # Bigram hashes; the constant keeps them apart from word hashes.
        bigrams = _mix(words[self.pair_state] * _MIX + words[self.pair_word] + np.uint64(1)) if len(pairs) else words[:0]
        self.hashes = (words, bigrams)

    def requests(self, training: np.ndarray, shards: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(shard, kind, hashes, training counts) for the words (0) and bigrams (1)."""
        learnt = np.repeat(training, self.lengths)
        out = []
        for kind, index in ((0, self.tokens), (1, self.arcs)):
            counts = np.bincount(index[learnt], minlength=len(self.hashes[kind]))
            for shard, places in self.shards(kind, shards):
                out.append((shard, kind, self.hashes[kind][places], counts[places]))
        return out

    def shards(self, kind: int, shards: int) -> list[tuple[int, np.ndarray]]:
        """Places of the hashes of each shard, in the order of the hashes."""
        shard = self.hashes[kind] % np.uint64(shards)
        order = np.lexsort((self.hashes[kind], shard))
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        return [(int(shard[places[0]]), places) for places in np.split(order, cuts) if len(places)]


class Automaton:
    """The part of the model that a block can reach."""

    def __init__(self, block: Block, words: np.ndarray, bigrams: np.ndarray, total: int, distinct: int,
                 weight: float = WEIGHT):
        below = total + 0.5 * (distinct + 1)
        root = (words + 0.5) / below
        context = words[block.pair_state]
        self.root = np.log10(root)                                          # by word
        self.failure = np.log10(weight / (words + weight))                  # by state
        arc = (bigrams + weight * root[block.pair_word]) / (context + weight)
        # By bigram: its own arc, or the failure arc and then the root's.
        self.arc = np.where(bigrams > 0, np.log10(arc), self.failure[block.pair_state] + self.root[block.pair_word])

    def traverse(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each text along its states, and at the root alone."""
        if not len(block.tokens):
            return np.zeros(0), np.zeros(0)
        return np.add.reduceat(self.arc[block.arcs], block.starts), np.add.reduceat(self.root[block.tokens], block.starts)


def score_documents(docs: DataFrame, train: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
                    weight: float = WEIGHT, block_bytes: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``held_out`` (not ``train`` of the
    id), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0
    blocks = shards = max(1, -(-int(size) // block_bytes))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.coalesce(train(F.col(id_col)), F.lit(False)).alias("training"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    id_type = rows.schema["id"].dataType
    parts = rows.mapInArrow(_deal, "block bigint, part binary")

    def ask(table: pa.Table) -> pa.Table:
        docs = _documents(table)
        block = Block(docs.column("text").to_pylist())
        training = docs.column("training").to_numpy(zero_copy_only=False).astype(bool)
        asked = block.requests(training, shards)
        number = table.column("block")[0].as_py()
        shard, kind, hashes, counts = zip(*asked)
        return pa.table({"shard": pa.array(shard, pa.int64()), "kind": pa.array(kind, pa.int32()),
                         "block": pa.array([number] * len(asked), pa.int64()),
                         "hashes": pa.array([h.tobytes() for h in hashes], pa.binary()),
                         "counts": pa.array([_pack(c) for c in counts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        counts = [_unpack(c, len(h)) for c, h in zip(table.column("counts").to_pylist(), hashes)]
        keys, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts).astype(float), minlength=len(keys)).astype(np.int64)
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        totals = [_pack(t) for t in np.split(sums[place], cuts)]
        kind = table.column("kind")[0].as_py()
        out = {n: table.column(n).to_pylist() for n in ("block", "kind", "shard")}
        for name, value in (("block", -1), ("kind", kind), ("shard", table.column("shard")[0].as_py())):
            out[name].append(value)
        # One row more for the model's size: training tokens and distinct ones of this shard.
        totals.append(np.array([sums.sum(), (sums > 0).sum()], np.int64).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()),
                         "shard": pa.array(out["shard"], pa.int64()), "totals": pa.array(totals, pa.binary())})

    asked = parts.groupBy("block").applyInArrow(ask, "shard bigint, kind int, block bigint, hashes binary, counts binary")
    answers = materialise(asked.groupBy("shard", "kind").applyInArrow(
        answer, "block bigint, kind int, shard bigint, totals binary"), "counts")

    def add(batches):
        n = v = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                a, b = np.frombuffer(t, np.int64)
                n, v = n + int(a), v + int(b)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], names=["n", "v"])

    sizes = answers.filter("block = -1 and kind = 0").select("totals")
    total, distinct = (int(x or 0) for x in sizes.mapInArrow(add, "n bigint, v bigint").agg(F.sum("n"), F.sum("v")).first())

    def score(key, texts: pa.Table, totals: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        texts = _documents(texts)
        block = Block(texts.column("text").to_pylist())
        counts = []
        for kind in (0, 1):
            values = np.zeros(len(block.hashes[kind]))
            mine = totals.filter(pc.equal(totals.column("kind"), kind))
            got = dict(zip(mine.column("shard").to_pylist(), mine.column("totals").to_pylist()))
            for shard, places in block.shards(kind, shards):
                values[places] = _unpack(got[shard], len(places))
            counts.append(values)
        log, base = Automaton(block, counts[0], counts[1], total, distinct, weight).traverse(block)
        known = np.add.reduceat((counts[0][block.tokens] > 0).astype(np.int64), block.starts) if len(block.tokens) else block.lengths
        held = ~texts.column("training").to_numpy(zero_copy_only=False).astype(bool)
        return pa.table([texts.column("id").combine_chunks(), pa.array(held), pa.array(block.lengths), pa.array(known),
                         pa.array(np.full(len(held), total, np.int64)), pa.array(base), pa.array(log)], names=names)

    scored = parts.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(
        score, f"id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")
    return scored
