import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pactlens.llm.common import reach_package
from pactlens.llm.conversation_repair import RESULT, damage, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """Cost, least audit and written rows, by taking partial edits in the order of (cost, audit)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, written = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, written
        asked = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        heapq.heappush(heap, (cost + 3, audit + "I", at, asked[0], (*written, asked + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, written))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, asked[0], (*written, f"{asked}:{text}")))
                if role[:1] == asked[:1] or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*written, f"{role}:{text}")))


def plain_repair(rows):
    """rows: (conv_id, turn, role, text, dropped)."""
    out = []
    for conv_id in {r[0] for r in rows}:
        live = [r[1:4] for r in rows if r[0] == conv_id and not r[4]]
        live = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in live), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in live:
            if not text.strip(SPACE):
                faults.append("blank")
                continue
            faults.append("duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, written = plain_edits([(r, x, f) for (_, r, x), f in zip(live, faults)])
        turns = {t for t, _, _ in live if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(written).encode()).hexdigest()
        out.append((conv_id, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv_id, turn, role, text)]
        fate = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", said[3]) if fate == 2 else said[3]
        out += [(conv_id, turn, "user" if fate == 4 else said[2], text, fate == 0)] * (2 if fate == 3 else 1)
    return out


def some_conversations(count, longest, seed):
    rng = random.Random(seed)
    texts = ["Hello there.", "What?", "no end", "", " \t", "é!\n", "Yes.", "cut off é", " ", "a.\u0085", None]
    roles = ["user", "assistant", "system", "User", "", None, "tool", "usher", "été"]
    rows = []
    for conv_id in [None, *range(count)]:
        for turn in range(rng.randrange(longest + 1)):
            usual = ("user", "assistant")[turn % 2]
            rows.append((conv_id, rng.choice([turn, turn, turn, None, -turn * 3]), rng.choice([usual, usual, usual, rng.choice(roles)]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(9)}."))
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture
def make(spark):
    reach_package(spark)
    return lambda rows, schema=SCHEMA: spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk_rows, partitions", [(4096, 3), (1, 3), (3, 7)])
def test_as_stated(make, spark, chunk_rows, partitions):
    rows = some_conversations(60, 12, seed=chunk_rows)
    frame = make(rows).repartition(partitions).withColumns({"chunk": F.lit(1), "pos": F.lit("x"), "open": F.lit(True), "conv": F.lit(2.0), "audits": F.lit(0)})
    assert got(repair(frame, chunk_rows)) == plain_repair([(*r, False) for r in rows])
    damaged = damage(frame)
    assert got(repair(damaged, chunk_rows)) == plain_repair(plain_damage(rows))


def test_damage_as_stated(make):
    rows = some_conversations(300, 8, seed=9)
    assert sorted(map(repr, (tuple(r) for r in damage(make(rows)).collect()))) == sorted(repr((*x[:2], *x[2:])) for x in plain_damage(rows))


def test_one_conversation_holds_most_rows(make, spark):
    rng = random.Random(3)
    rows = [(7, n, ("user", "assistant", "system")[rng.choice([0, 1, 0, 1, 2])], rng.choice(["So.", "cut", "", f"say {n}."])) for n in range(900)]
    rows += some_conversations(20, 6, seed=4)
    frame = make(rows).repartition(6)
    want = plain_repair([(*r, False) for r in rows])
    assert got(repair(frame, chunk_rows=64)) == want
    assert got(repair(frame)) == want


def test_very_long_text_and_repeated_rows(make):
    long_text = "word " * 1_000_000 + "end."
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", long_text), (1, 2, "user", long_text), (2, 0, "user", "A."), (2, 0, "user", "A."), (2, None, "system", "B.")]
    assert got(repair(make(rows))) == plain_repair([(*r, False) for r in rows])


def test_all_rows_dropped_and_far_turns(make):
    rows = [(1, 0, "user", "A.", True), (1, 1, "user", "B.", True), (2, -(2**63), "user", "A.", False), (2, 2**63 - 1, "assistant", "B.", False)]
    found = got(repair(make(rows, SCHEMA + ", dropped boolean"), chunk_rows=1))
    assert found[0] == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[1][:2] == (2, 2**63 - 1) and found[1][6:8] == (0, "KK")


def test_empty_table(make):
    frame = repair(damage(make([])))
    assert frame.collect() == [] and frame.columns == [x.split()[0] for x in RESULT.split(", ")]
