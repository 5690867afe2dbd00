import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lakeshore.llm import conversations as cv
from lakeshore.llm import queries

ROWS = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\f\r"


def plain(rows):
    """Least cost and audit by trying all edit sequences of rising cost."""
    def ways(i, roles, cost, audit, budget):
        if cost > budget:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            yield cost, audit
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        for letter in "ua":
            yield from ways(i, roles + letter, cost + 2, audit + "I", budget)
        if i < len(rows):
            letter, wrong = rows[i]
            yield from ways(i + 1, roles, cost + 3, audit + "D", budget)
            if wrong not in (cv.BLANK, cv.DUPLICATE):
                more = int(wrong == cv.CUT)
                if letter:
                    yield from ways(i + 1, roles + letter, cost + more, audit + "K", budget)
                for new in "ua":
                    yield from ways(i + 1, roles + new, cost + 2 + more, audit + "R", budget)
    budget = 0
    while True:
        found = min(ways(0, "", 0, "", budget), default=None)
        if found:
            return found
        budget += 1


def least(rows):
    """The same for long conversations: all nodes from the front, layer by layer."""
    inf = (10**9, "")

    def inserts(layer):
        for _ in range(4):
            for s in range(4):
                t = cv.NEXT[s][cv.MADE[s]]
                layer[t] = min(layer[t], (layer[s][0] + 2, layer[s][1] + "I"))
        return layer
    layer = inserts([(0, ""), inf, inf, inf])
    for letter, wrong in rows:
        new = [inf] * 4
        for s, (cost, audit) in enumerate(layer):
            options = [("D", 3, s)]
            if wrong not in (cv.BLANK, cv.DUPLICATE):
                more = int(wrong == cv.CUT)
                if letter in cv.NEXT[s]:
                    options.append(("K", more, cv.NEXT[s][letter]))
                options.append(("R", 2 + more, cv.NEXT[s][cv.MADE[s]]))
            for e, add, t in options:
                new[t] = min(new[t], (cost + add, audit + e))
        layer = inserts(new)
    return min(layer[0], layer[3])


def expected(rows):
    """Results by conversation of (conv, turn, role, text) rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv and r[4]], key=lambda r: (r[1] is not None, r[1] or 0))
        seen, lattice, faults = set(), [], [0, 0, 0, 0]
        for _, _, role, text, _ in mine:
            end = text.rstrip(SPACE)
            wrong = cv.BLANK if not end else cv.DUPLICATE if (role, text) in seen else cv.SOUND if end[-1] in ".!?" else cv.CUT
            seen.add((role, text))
            faults[wrong] += 1
            lattice.append((role[:1], wrong))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:]))
        cost, audit = least(lattice)
        i, state, said = 0, 0, []
        for edit in audit:
            if edit in "KRD":
                role, text = mine[i][2:4]
                i += 1
            if edit == "D":
                continue
            letter = role[:1] if edit == "K" else cv.MADE[state]
            if edit != "K":
                role = {"u": "user", "a": "assistant"}[letter]
            said.append(f"{role}:{'' if edit == 'I' else text}")
            state = cv.NEXT[state][letter]
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    return out


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_search_equals_all_edit_sequences():
    rnd = random.Random(3)
    for _ in range(250):
        rows = [(rnd.choice("suuaa xU") if rnd.random() < 0.95 else "", rnd.choices(range(4), (6, 1, 1, 2))[0]) for _ in range(rnd.randint(0, 4))]
        assert cv.cheapest(rows) == plain(rows) == least(rows), rows


def test_search_on_longer_conversations():
    rnd = random.Random(4)
    for _ in range(300):
        rows = [(rnd.choice("suuuaaa x"), rnd.choices(range(4), (6, 1, 1, 2))[0]) for _ in range(rnd.randint(5, 40))]
        assert cv.cheapest(rows) == least(rows), rows


def odd_conversations():
    rnd = random.Random(9)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "User", "supervisor"])
            text = rnd.choice(["Hello.", "Why?", "cut", "", " \t\n", None, "Yes! ", "é。", "Ok.\x0b", "…", "a." * 30, "one\ntwo.", "x"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 7, None]), role, text))
    # One row a turn, so that the order is given; rows that repeat stay.
    once = list({(r[0], r[1]): r for r in rows}.values())
    return once + once[:40]


@pytest.mark.parametrize("limits", [(512, 8 << 20), (3, 8 << 20), (512, 20)])
def test_query_equals_brute_force(spark, clash, monkeypatch, limits):
    monkeypatch.setattr(cv, "ROWS", limits[0])
    monkeypatch.setattr(cv, "BYTES", limits[1])
    rows = odd_conversations()
    df = clash(spark.createDataFrame(rows, ROWS).repartition(5)).withColumn("conv", F.lit("x")).withColumn("kind", F.lit("y"))
    want = expected(damaged(rows))
    assert collected(cv.repair(cv.damage(df))) == want


def test_one_long_conversation_in_many_tasks(spark):
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice(["A.", "B?", "cut", "", f"t {t}."]))
            for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collected(cv.repair(cv.damage(df)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == expected(damaged(rows))


def test_messages_are_the_repaired_rows(spark):
    rows = odd_conversations()
    df = cv.damage(spark.createDataFrame(rows, ROWS))
    result = collected(cv.repair(df))
    said = {}
    for r in sorted(cv.repair(df, messages=True).collect(), key=lambda r: r.place):
        said.setdefault(r.conv, []).append(r)
    for conv, (*_, audit, digest) in result.items():
        messages = said.get(conv, [])
        assert [m.place for m in messages] == list(range(len(messages)))
        assert [m.edit for m in messages] == [e for e in audit if e != "D"]
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in messages).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in messages))


def test_dropped_conversations_and_empty_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert cv.repair(cv.damage(empty)).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(conv, 0, "user", "Hi.")], ROWS)
    assert collected(cv.repair(cv.damage(one))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_query_over_the_whole_table(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op12_conversations"](spark, sf01)) == expected(damaged(rows))
