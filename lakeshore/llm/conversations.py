"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

Roles are read by their first letter and have to follow ``(s?(ua)+)?``.  The
lattice of a conversation has a node for each (rows read, state); the states
are nothing yet, after a system, a user and an assistant row.  Edits: Keep
(free), Rerole to user or assistant (2), Delete (3; the only edit of a blank
or repeated row), Insert an empty user or assistant row (2); a truncated row
that stays costs 1 more.  Of the cheapest ways the one with the least audit
(the edits' letters in order) is taken.

Search: a heap from the front and one from the back take nodes by (cost, rows
passed), so every equally cheap way into a node is known when it is taken, and
each keeps its least audit.  They stop when the two next costs together exceed
the best meeting; every crossing of that cost, node or edge, is then finished
and the least joined audit wins.  (Two equally cheap ways between the same
nodes never have audits of which one begins the other: it would have to cost
less.  So least parts make the least whole.)

Rows are sorted by range of (conversation, turn, ...) and read as a stream.  A
conversation that lies within one task and within ``ROWS`` rows and ``BYTES``
bytes is solved there.  All others (at most two a task, and long ones) are
taken up again: repeats are found by an aggregation over (conversation, role,
text), stretches of ``ROWS`` rows are solved side by side for every pair of
states at their ends, and one pass over the stretches and rows of a
conversation, in order, joins them and writes the result.  That pass holds four
audits of the conversation, never its texts; its time grows with the
longest conversation because a hash of a whole text has to be taken in order.

Defined cases: null turns come first; rows of one turn are taken by role, then
a hash of the text; null roles and texts count as one space (such a row is blank, or has a
role that no place allows); an empty role has no letter and fits nowhere; null
conversation ids are one conversation; repeated rows are duplicates; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshore.llm.common import ASCII_SPACE, materialise, small_batches

#: Rows and bytes of a conversation or stretch that a task solves at once.
ROWS, BYTES = 512, 8 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of this letter, by state before.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The letter of an inserted or changed row, by state before.
MADE = "uuau"
ROLE = {"u": "user", "a": "assistant"}
LAST = (NOTHING, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)
Node = tuple[int, int]


def known(letter: str) -> str:
    """The letter if a role may have it anywhere, else none."""
    return letter if letter and letter in "sua" else ""


def fault(text: str) -> int:
    """Blank or cut short, by the text alone."""
    end = text.rstrip(ASCII_SPACE)
    return BLANK if not end else SOUND if end[-1] in ".!?" else CUT


@cache
def moves(letter: str, wrong: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """By state before: (edit, cost, state after) of the edits that read a row
    whose role has this letter and that has this fault."""
    extra = TRUNCATED if wrong == CUT else 0
    out = []
    for state in range(4):
        found = [("D", DELETE, state)]
        if wrong not in (BLANK, DUPLICATE):
            if letter in NEXT[state]:
                found.append(("K", extra, NEXT[state][letter]))
            found.append(("R", REROLE + extra, NEXT[state][MADE[state]]))
        out.append(tuple(found))
    return tuple(out)


def turned(forward: tuple) -> tuple:
    """The same edits by state after: (edit, cost, state before)."""
    return tuple(tuple((edit, cost, before) for before in range(4) for edit, cost, after in forward[before] if after == state)
                 for state in range(4))


moves_back = cache(lambda letter, wrong: turned(moves(letter, wrong)))
INSERTS = tuple((("I", INSERT, NEXT[state][MADE[state]]),) for state in range(4))
INSERTS_BACK = turned(INSERTS)


def edits(node: Node, rows: list[tuple[str, int]]) -> list[tuple[str, int, Node]]:
    """(letter, cost, next node) of the edits at a node; ``rows``: (letter of the role, fault)."""
    i, state = node
    out = [(edit, cost, (i, to)) for edit, cost, to in INSERTS[state]]
    if i < len(rows):
        out += [(edit, cost, (i + 1, to)) for edit, cost, to in moves(*rows[i])[state]]
    return out


def edits_back(node: Node, rows: list[tuple[str, int]]) -> list[tuple[str, int, Node]]:
    """(letter, cost, node before) of the edits that lead to a node."""
    i, state = node
    out = [(edit, cost, (i, to)) for edit, cost, to in INSERTS_BACK[state]]
    if i:
        out += [(edit, cost, (i - 1, to)) for edit, cost, to in moves_back(*rows[i - 1])[state]]
    return out


class Side:
    """One of the two searches: least (cost, audit) of each node reached."""

    def __init__(self, starts: list[Node], rows: list[tuple[str, int]], back: bool):
        self.rows, self.back = rows, back
        self.best = {node: (0, "") for node in starts}
        self.done: set[Node] = set()
        self.heap = [(0, 0, node) for node in starts]
        self.origin = starts[0][0]
        heapq.heapify(self.heap)

    def cost(self) -> int | None:
        """Cost of the next node, None if there is none."""
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def step(self) -> tuple[Node, int]:
        cost, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        audit = self.best[node][1]
        for letter, add, other in (edits_back if self.back else edits)(node, self.rows):
            if other in self.done:
                continue
            way = cost + add, letter + audit if self.back else audit + letter
            if other not in self.best or way < self.best[other]:
                new = other not in self.best or way[0] < self.best[other][0]
                self.best[other] = way
                if new:
                    heapq.heappush(self.heap, (way[0], abs(other[0] - self.origin), other))
        return node, cost


def cheapest(rows: list[tuple[str, int]], first: int = NOTHING, last: tuple[int, ...] = LAST) -> tuple[int, str] | None:
    """Least cost and audit from state ``first`` before the rows to one of
    the states ``last`` behind them; None if no edits lead there."""
    ahead = Side([(0, first)], rows, False)
    behind = Side([(len(rows), state) for state in last], rows, True)
    best: int | None = None
    # The ends are taken first, so that every way crosses from the one side's nodes to the other's.
    for side, ends in ((ahead, 1), (behind, len(last))):
        for _ in range(ends):
            side.step()
    for node in ahead.best.keys() & behind.best.keys():
        both = ahead.best[node][0] + behind.best[node][0]
        best = both if best is None else min(best, both)
    while True:
        a, b = ahead.cost(), behind.cost()
        if a is None or b is None or best is not None and a + b > best:
            break
        side, other = (ahead, behind) if (a, len(ahead.heap)) <= (b, len(behind.heap)) else (behind, ahead)
        node, cost = side.step()
        if node in other.best and (best is None or cost + other.best[node][0] < best):
            best = cost + other.best[node][0]
    if best is None:
        return None
    audits = []
    for node in ahead.done:
        cost, audit = ahead.best[node]
        if node in behind.done and cost + behind.best[node][0] == best:
            audits.append(audit + behind.best[node][1])
        for letter, add, after in edits(node, rows):
            if after in behind.done and cost + add + behind.best[after][0] == best:
                audits.append(audit + letter + behind.best[after][1])
    return best, min(audits)


class Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the inserts that stand before the next row."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            letter = MADE[self.state]
            self.state = NEXT[self.state][letter]
            self.at += 1
            yield "I", ROLE[letter], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The inserts before a row, and the row if it stays."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        letter = role[:1] if edit == "K" else MADE[self.state]
        self.state = NEXT[self.state][letter]
        yield edit, role if edit == "K" else ROLE[letter], text


@dataclass
class Counts:
    """Figures over rows in order; ``add`` takes the figures of the rows behind."""
    low: int | None = None
    high: int | None = None
    turns: int = 0                  # distinct, not null
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    first: str | None = None        # letters of the outer roles
    last: str | None = None

    def add(self, o: Counts) -> None:
        if o.first is not None:
            if self.last is not None:
                self.illegal += self.last + o.first not in ("su", "ua", "au")
            self.first, self.last = o.first if self.first is None else self.first, o.last
        self.illegal += o.illegal
        self.faults = [x + y for x, y in zip(self.faults, o.faults)]
        if o.low is not None:       # rows come by turn
            self.turns += o.turns - (self.high == o.low)
            self.low, self.high = o.low if self.low is None else self.low, o.high

    @staticmethod
    def row(turn: int | None, letter: str, wrong: int) -> Counts:
        out = Counts(turn, turn, int(turn is not None), first=letter, last=letter)
        out.faults[wrong] = 1
        return out

    def figures(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal


def counts_of(rows: list[tuple[int | None, str, int]]) -> Counts:
    out = Counts()
    for row in rows:
        out.add(Counts.row(*row))
    return out


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
MESSAGE = "place bigint, edit string, role string, text string"
_RESULT = [pa.int64()] * 6 + [pa.string()] * 2
_MESSAGE = [pa.int64()] + [pa.string()] * 3
EMPTY = hashlib.sha256().hexdigest()


class Writer:
    """Result rows of a stream of conversations, either figures or messages."""

    def __init__(self, key_type: pa.DataType, messages: bool):
        self.types = [key_type, *(_MESSAGE if messages else _RESULT)]
        names = MESSAGE if messages else RESULT
        self.names = ["conv", *[x.split()[0] for x in names.split(", ")]]
        self.messages, self.rows, self.size = messages, [], 0

    def message(self, key: object, place: int, message: tuple[str, str, str]) -> None:
        if self.messages:
            self.rows.append((key, place, *message))
            self.size += len(message[2])

    def result(self, key: object, counts: Counts, cost: int, audit: str, digest: str) -> None:
        if not self.messages:
            self.rows.append((key, *counts.figures(), cost, audit, digest))
            self.size += len(audit)

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.size >= 1 << 22

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.types)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=self.names)


def solve(key: object, rows: list[tuple], out: Writer) -> None:
    """A whole conversation: ``rows`` (turn, role, text) in order, those that are there."""
    seen, lattice, facts = set(), [], []
    for turn, role, text in rows:
        wrong = fault(text)
        if wrong != BLANK and (role, text) in seen:
            wrong = DUPLICATE
        seen.add((role, text))
        lattice.append((known(role[:1]), wrong))
        facts.append((turn, role[:1], wrong))
    cost, audit = cheapest(lattice)
    finish(key, counts_of(facts), cost, audit, iter([(r, t) for _, r, t in rows]), out)


def finish(key: object, counts: Counts, cost: int, audit: str, rows: Iterator[tuple[str, str]], out: Writer) -> None:
    """Applies the audit to the rows as they come, and writes the result."""
    digest, repair, place = hashlib.sha256(), Repair(audit), 0

    def take(messages: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place
        for edit, role, text in messages:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.message(key, place, (edit, role, text))
            place += 1

    for role, text in rows:
        take(repair.row(role, text))
    take(repair.inserted())
    out.result(key, counts, cost, audit, digest.hexdigest())


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of rows (conv, there, turn, role, text) of one conversation, cut
    at ``ROWS`` rows and ``BYTES`` bytes."""
    rows: list[tuple] = []
    size = 0
    for batch in small_batches(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            weight = len(row[4])
            if rows and (row[0] != rows[0][0] or len(rows) >= ROWS or size + weight > BYTES):
                yield rows[0][0], rows
                rows, size = [], 0
            rows.append(row)
            size += weight
    if rows:
        yield rows[0][0], rows


def _digest() -> Column:
    """128 bits of role and text."""
    return F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.md5(F.col("text").cast("binary"))).cast("binary"))


def repair(rows: DataFrame, messages: bool = False) -> DataFrame:
    """Repairs the conversations of ``rows`` (conv, there, turn, role, text; a
    row that is not ``there`` only names its conversation).  One row per
    conversation: ``conv``, counts of ``gaps``, ``blank``, ``duplicate``,
    ``truncated`` and ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256`` of the repaired text; or, with ``messages``, the
    repaired rows: ``conv``, ``place``, ``edit``, ``role``, ``text``."""
    key_type = rows.schema["conv"].dataType.simpleString()
    rows = rows.select("conv", "there", F.col("turn").cast("bigint").alias("turn"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = ["conv", "there", "turn", "role", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    names = MESSAGE if messages else RESULT

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edge = TaskContext.get().partitionId(), object()
        out, opened = None, []
        n = stretch = 0

        def written() -> Iterator[pa.RecordBatch]:
            solved = out.batch()
            left = list(zip(*opened)) if opened else [()] * 7
            opened.clear()
            columns = [pa.concat_arrays([solved.column(0), pa.array(left[0], solved.column(0).type)])]
            columns += [pa.concat_arrays([solved.column(i), pa.nulls(len(left[0]), t)]) for i, t in enumerate(out.types[1:], 1)]
            types = [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for values, t in zip([*left[1:5], [part] * len(left[0]), *left[5:7]], types):
                columns.append(pa.concat_arrays([pa.nulls(solved.num_rows, t), pa.array(values, t)]))
            yield pa.RecordBatch.from_arrays(columns, names=[*[f"r_{x}" for x in out.names], "there", "turn", "role", "text", "part", "stretch", "row"])

        def runs() -> Iterator[tuple[list[tuple], bool]]:
            """Runs, and whether each is a whole conversation: neither the first nor the last of this task, nor cut."""
            before, run = edge, None
            for key, found in conversations(typed(batches)):
                if run is not None:
                    yield run, before is not edge and before != run[0][0] and key != run[0][0]
                    before = run[0][0]
                run = found
            if run is not None:
                yield run, False

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal out
            for batch in batches:
                if out is None:
                    out = Writer(batch.schema.field(0).type, messages)
                yield batch

        for run, whole in runs():
            if whole:
                solve(run[0][0], [r[2:] for r in run if r[1]], out)
            else:
                opened.extend((*r, stretch, n + i) for i, r in enumerate(run))
                stretch, n = stretch + 1, n + len(run)
            if out.full() or sum(len(r[4]) for r in opened) > BYTES or len(opened) > 4096:
                yield from written()
        if out is not None:
            yield from written()

    schema = f"r_conv {key_type}, " + ", ".join(f"r_{x}" for x in names.split(", ")) + (
        ", there boolean, turn bigint, role string, text string, part bigint, stretch bigint, row bigint")
    first_pass = materialise(ordered.mapInArrow(near, schema), "conversations")
    solved = first_pass.filter("there is null").select(*[F.col(f"r_{c}").alias(c) for c in ["conv", *[x.split()[0] for x in names.split(", ")]]])
    left = first_pass.filter("there is not null").select(F.col("r_conv").alias("conv"), "there", "turn", "role", "text", "part", "stretch", "row")
    return solved.unionByName(_repair_long(left, key_type, messages))


def _repair_long(left: DataFrame, key_type: str, messages: bool) -> DataFrame:
    """Conversations over several tasks or stretches, from rows numbered by (part, row)."""
    place = F.struct("part", "row")
    there = left.filter("there").withColumn("digest", _digest())
    firsts = there.groupBy("conv", "digest").agg(F.min(place).alias("first")).select("first.*").withColumn("new", F.lit(True))
    marked = there.join(firsts, ["part", "row"], "left")
    end = F.substring(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), -1, 1)
    wrong = F.when(end == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)
    facts = marked.select("conv", "part", "stretch", "row", "turn", F.substring("role", 1, 1).alias("letter"), wrong.alias("fault"))

    def bridge(key: tuple, table: pa.Table) -> pa.Table:
        """A stretch for every pair of states at its ends."""
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("row", "turn", "letter", "fault")]))
        lattice = [(known(letter), wrong) for _, _, letter, wrong in rows]
        ways = [(s, t, *way) for s in range(4) for t in range(4)
                if (t >= USER or s <= t) and (way := cheapest(lattice, s, (t,)))]
        c = counts_of([r[1:] for r in rows])
        return pa.table({"conv": table.column("conv")[:1], "kind": pa.array([1], pa.int32()), "part": table.column("part")[:1],
                         "row": pa.array([rows[0][0]], pa.int64()), "role": pa.array([None], pa.string()), "text": pa.array([None], pa.string()),
                         "ways": pa.array([[dict(zip(("a", "b", "cost", "audit"), w)) for w in ways]], WAYS),
                         "counts": pa.array([vars(c)], COUNTS)})

    schema = (f"conv {key_type}, kind int, part bigint, row bigint, role string, text string, "
              "ways array<struct<a:int,b:int,cost:bigint,audit:string>>, "
              "counts struct<low:bigint,high:bigint,turns:bigint,faults:array<bigint>,illegal:bigint,first:string,last:string>")
    bridges = facts.groupBy("conv", "part", "stretch").applyInArrow(bridge, schema)
    named = left.select("conv").distinct().withColumn("kind", F.lit(0))
    rows = there.select("conv", F.lit(2).alias("kind"), "part", "row", "role", "text")
    stream = named.unionByName(bridges, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    stream = stream.select("conv", "kind", "part", "row", "role", "text", "ways", "counts")
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", "part", "row")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Writer | None = None
        rows = _rows(batches)
        row = next(rows, None)
        while row is not None:
            if out is None:
                out = Writer(row[-1], messages)
            key, counts, best = row[0], Counts(), {NOTHING: (0, "")}
            row = next(rows, None)
            while row is not None and row[1] == 1:
                counts.add(Counts(**row[7]))
                after: dict[int, tuple[int, str]] = {}
                for way in row[6]:
                    if way["a"] in best:
                        cost, audit = best[way["a"]]
                        new = cost + way["cost"], audit + way["audit"]
                        if way["b"] not in after or new < after[way["b"]]:
                            after[way["b"]] = new
                best = after
                row = next(rows, None)
            cost, audit = min(best[state] for state in LAST if state in best)

            def texts() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[1] == 2:
                    yield row[4], row[5]
                    row = next(rows, None)

            finish(key, counts, cost, audit, texts(), out)
            if out.full():
                yield out.batch()
        if out is not None:
            yield out.batch()

    return stream.mapInArrow(join, f"conv {key_type}, " + (MESSAGE if messages else RESULT))


WAYS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("faults", pa.list_(pa.int64())),
                    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in small_batches(batches, 64):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield *row, batch.schema.field(0).type


def damage(rows: DataFrame) -> DataFrame:
    """The test damage of ``conversations`` rows by a checksum of their place,
    as input of ``repair``: dropped rows stay as a name of their conversation."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    out = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    marks = F.col("text")
    for mark in ".!?":
        marks = F.replace(marks, F.lit(mark), F.lit(""))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, marks).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.select("conv", (F.col("kind") != 0).alias("there"), "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
