"""Conversation structure repair: the cheapest edits that give each conversation the roles `(system? (user assistant)+)?`.

Rows of a conversation are taken by turn (nulls first), then role, then text. A row's first fault counts: blank (nothing but
ASCII white space), duplicate (role and text seen earlier in the conversation), truncated (its last character that is no
white space is none of `.!?`). Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and
duplicate rows), Insert an empty user or assistant row 3; a truncated row that stays adds 3.

Cost. A node is (rows read, state), a state what was written last: nothing, system, user or assistant. Arcs are edits. Costs to
the end are computed backwards; an arc is optimal when its cost is the difference of its nodes' costs.

Path ranking by prefix doubling. The optimal arcs of a node have different letters, so its least path goes by its least arc.
Nodes are ranked by the first letter of their audit (the edits' initials, ASCII order, an ended audit before all), then by the
first 2, 4, 8, ... letters: the rank for twice the length is that of the pair (own rank, rank of the node the pointer leads
to), and the pointer is doubled with it. After the last round equal ranks mean equal audits: each different audit is read
once, by following the doubled pointers, and given to all conversations whose first node has its rank.

Distribution. Rows are range-partitioned by conversation and turn. A conversation that lies inside a partition and has at most
`chunk_rows` rows and CHUNK_BYTES bytes is solved there. Every other one, a conversation with a third of all rows included,
goes on in chunks of that size, over all tasks: a chunk is first reduced to the 4 x 4 costs between its border states, these
are joined backwards (one short row per chunk) to the cost at each chunk's end, and with it each chunk's four possible
audits are found on their own. The last step reads the rows of such a conversation in order through one task, because a
SHA-256 has no other way; it holds one batch of rows and the audit.

Defined results: a null role or text is one space; rows with a null conv_id are one conversation; equal rows are duplicates
of the first; an empty conversation (all rows dropped) has zeros, an empty audit and the hash of the empty string; gaps that
pass the range of a long are its maximum; a very long text is held by one task at a time; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import longs
from pactlens.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = b"DIKR"  # in ASCII order
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)  # the state after writing what a state asks for
ASKED = (b"user", b"user", b"assistant", b"user")
NEVER = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)  # cost of ending in each state
_END_LETTERS = (b"", b"II", b"I", b"")

CHUNK_ROWS, CHUNK_BYTES = 4096, 16 << 20
_GROUP_ROWS = 16_384  # rows of conversations that are ranked together
_SPACE = " \t\n\x0b\x0c\r"
_MAX = (1 << 63) - 1

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- input -------------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `dropped` of damaged rows; which damage a row takes follows from crc32(`conv_id:turn`) % 20.

    0 drops it (its conversation stays known), 1 empties its text, 2 removes `.!?` from it, 3 repeats the row, 4 makes it the user's.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), fate.alias("fate")
    )
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("dropped"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """What the tasks read, by conversation and turn over range partitions."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    told = F.rtrim(text, F.lit(_SPACE))
    ended = told.endswith(".") | told.endswith("!") | told.endswith("?")
    read = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        (told == "").alias("blank"),
        (~ended).alias("truncated"),
        F.coalesce(dropped, F.lit(False)).alias("dropped"),
    )
    first: list[Column | str] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    # The partitions' order goes by the head of a text, so that borders stay small; the full order refines it.
    return read.repartitionByRange(*first, F.substring("text", 1, 64)).sortWithinPartitions(*first, "text")


# --- costs -------------------------------------------------------------------------------------------------------


class Row(NamedTuple):
    turn: int | None
    role: bytes
    text: bytes
    initial: int  # the state its role leads to, 0 for any other role
    blank: bool
    duplicate: bool
    truncated: bool


_STATE = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}


def initial(role: bytes) -> int:
    return _STATE.get(role[:1], 0)


def distances(rows: list, end: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each number of rows read and each state the cost of the rest, given that after the last row."""
    d0, d1, d2, d3 = end
    found = [(d0, d1, d2, d3)]
    for row in reversed(rows):
        p0, p1, p2, p3 = DELETE + d0, DELETE + d1, DELETE + d2, DELETE + d3
        if not (row.blank or row.duplicate):
            stays = TRUNCATED if row.truncated else KEEP
            user = d2 + (stays if row.initial == USER else stays + REROLE)
            p2 = min(p2, d3 + (stays if row.initial == ASSISTANT else stays + REROLE))
            p0, p1, p3 = min(p0, user), min(p1, user), min(p3, user)
            if row.initial == SYSTEM:
                p0 = min(p0, stays + d1)
        d2, d3 = min(p2, INSERT + p3), min(p3, INSERT + p2)
        d0, d1 = min(p0, INSERT + d2), min(p1, INSERT + d2)
        found.append((d0, d1, d2, d3))
    return found[::-1]


def optimal_arcs(rows: list, costs: np.ndarray, ends: np.ndarray, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letter (4: none) and target of each node's least optimal arc. Nodes are 4 x place + state.

    `costs` holds the places of all conversations one after another, `ends` the last place of each, and `rows` a row for each
    place (None at an end). With `closing`, an end's arcs are the Inserts that complete a conversation.
    """
    n = len(costs)
    state, after = np.arange(4), np.array(AFTER)
    must = np.array([row is not None and (row.blank or row.duplicate) for row in rows])
    stays = np.array([TRUNCATED if row is not None and row.truncated else KEEP for row in rows])
    lead = np.array([0 if row is None else row.initial for row in rows])
    inside = np.ones(n, bool)
    inside[ends] = False
    following = np.minimum(np.arange(n) + 1, n - 1)
    below, ahead, along = costs[following], costs[following][:, after], costs[:, after]
    fits = lead[:, None] == after[None, :]
    letter = np.full((n, 4), 4)
    target = np.broadcast_to(4 * np.arange(n)[:, None] + state, (n, 4)).copy()

    def offer(code: int, possible: np.ndarray, to: np.ndarray) -> None:
        better = possible & (code < letter)
        letter[better] = code
        target[better] = to[better]

    known = costs < NEVER
    offer(0, known & inside[:, None] & (costs == DELETE + below), 4 * following[:, None] + state)
    offer(1, known & (inside[:, None] | closing) & (costs == INSERT + along), np.broadcast_to(4 * np.arange(n)[:, None] + after, (n, 4)))
    free = known & (inside & ~must)[:, None]
    onward = np.broadcast_to(4 * following[:, None] + after, (n, 4))
    offer(2, free & fits & (costs == stays[:, None] + ahead), onward)
    system = np.zeros((n, 4), bool)
    system[:, START] = free[:, START] & (lead == SYSTEM) & (costs[:, START] == stays + below[:, SYSTEM])
    offer(2, system, np.broadcast_to(4 * following[:, None] + SYSTEM, (n, 4)))
    offer(3, free & (costs == REROLE + stays[:, None] + ahead), onward)
    return letter.ravel(), target.ravel()


# --- ranks -------------------------------------------------------------------------------------------------------


def ranked_audits(letter: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The audit from each start, and the node it ends in, by ranks of prefixes of doubled lengths."""
    rank, jump = np.where(letter < 4, letter + 1, 0), target  # an ended audit ranks lowest and stays where it is
    jumps = [jump]
    while np.any(letter[jump[starts]] < 4):
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1].ravel()
        jump = jump[jump]
        jumps.append(jump)
    # The next rank's pairs would all end with "ended": the ranks are those of the whole audits.
    _, first, same = np.unique(rank[starts], return_index=True, return_inverse=True)
    owner, step, node = np.arange(len(first)), np.zeros(len(first), np.int64), starts[first]
    for k, pointer in enumerate(jumps):
        owner, step, node = np.concatenate([owner, owner]), np.concatenate([step, step + (1 << k)]), np.concatenate([node, pointer[node]])
        going = letter[node] < 4
        owner, step, node = owner[going], step[going], node[going]
    order = np.lexsort((step, owner))
    spelled = np.frombuffer(LETTERS, np.uint8)[letter[node[order]]].tobytes()
    edges = np.searchsorted(owner[order], np.arange(len(first) + 1))
    audits = [spelled[a:b] for a, b in zip(edges, edges[1:])]
    last = starts
    for pointer in jumps:
        last = pointer[last]
    return [audits[n] for n in same.ravel()], last


def repaired(rows: list, audit: bytes, state: int) -> tuple[list[bytes], int]:
    """The rows that `audit` writes from `state` on, as `role:text`, and the state after them."""
    out, at = [], 0
    for code in audit:
        if code == 68:  # D
            at += 1
            continue
        if code == 73:  # I
            out.append(ASKED[state] + b":")
        else:
            row = rows[at]
            at += 1
            if code == 75:  # K
                out.append(row.role + b":" + row.text)
                if state == START and row.initial == SYSTEM:
                    state = SYSTEM
                    continue
            else:
                out.append(ASKED[state] + b":" + row.text)
        state = AFTER[state]
    return out, state


# --- conversations inside a partition ----------------------------------------------------------------------------


def gap_count(least: int | None, most: int | None, different: int) -> int:
    return 0 if least is None else min(most - least + 1 - different, _MAX)


def illegal_pairs(initials: list[bytes]) -> int:
    return sum(a + b not in (b"su", b"ua", b"au") for a, b in zip(initials, initials[1:]))


def first_letter(role: bytes) -> bytes:
    return role.decode("utf-8", "replace")[:1].encode()


def solve(conversations: list[tuple[int | None, list[Row]]]) -> Iterator[tuple]:
    """Rows of RESULT for whole conversations; their nodes are ranked together."""
    if not conversations:
        return
    costs: list[tuple] = []
    places: list[Row | None] = []
    starts, ends = [], []
    for _, rows in conversations:
        starts.append(len(costs))
        costs += distances(rows, END)
        ends.append(len(costs) - 1)
        places += [*rows, None]
    at = np.array(costs)
    letter, target = optimal_arcs(places, at, np.array(ends), closing=True)
    audits, _ = ranked_audits(letter, target, 4 * np.array(starts) + START)
    for (conv_id, rows), audit, start in zip(conversations, audits, starts):
        written, _ = repaired(rows, audit, START)
        turns = {row.turn for row in rows if row.turn is not None}
        yield (
            conv_id,
            gap_count(min(turns, default=None), max(turns, default=None), len(turns)),
            sum(row.blank for row in rows),
            sum(row.duplicate for row in rows),
            sum(row.truncated for row in rows),
            illegal_pairs([first_letter(row.role) for row in rows]),
            int(at[start][START]),
            audit.decode(),
            hashlib.sha256(b"\n".join(written)).hexdigest(),
        )


def judged(raw: list[tuple]) -> list[Row]:
    """Rows with their first fault, from (turn, role, text, blank, truncated) of a whole conversation."""
    seen: set[tuple[bytes, bytes]] = set()
    rows = []
    for turn, role, text, blank, truncated in raw:
        duplicate = False
        if not blank:
            duplicate = (role, text) in seen
            seen.add((role, text))
        rows.append(Row(turn, role, text, initial(role), blank, duplicate, truncated and not blank and not duplicate))
    return rows


_MIXED = RESULT + ", open boolean, chunk long, pos int, turn long, role string, text string, is_blank boolean, is_truncated boolean"


def _done(rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    columns = list(zip(*rows))
    nothing = lambda kind: pa.nulls(n, kind)
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    rest = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([False] * n), *map(nothing, rest)]
    return pa.RecordBatch.from_arrays(arrays, _names(_MIXED))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _open(conv_id: int | None, chunk: int, raw: list[tuple]) -> pa.RecordBatch:
    """A chunk's head (pos -1), which names it even when it has no rows, and its rows."""
    n = len(raw) + 1
    turn, role, text, blank, truncated = zip((None, None, None, False, False), *raw)
    as_text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
    arrays = [longs([conv_id] * n), *(pa.nulls(n, pa.int64()) for _ in range(6)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
    arrays += [pa.array([True] * n), longs([chunk] * n), pa.array(range(-1, n - 1), pa.int32()), longs(turn), as_text(role), as_text(text)]
    arrays += [pa.array(blank, pa.bool_()), pa.array(truncated, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, _names(_MIXED))


def _partition(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie inside this partition, and chunks of all others."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    number = size = 0
    raw: list[tuple] = []
    current: tuple | None = None
    opened = True  # the first conversation may have begun in the partition before
    group: list[tuple] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        nonlocal number, raw, size
        made = _open(current[0], base + number, raw)
        number, raw, size = number + 1, [], 0
        return made

    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        as_bytes = lambda name: columns[name].cast(pa.large_binary()).to_pylist()
        plain = [columns[name].to_pylist() for name in ("conv_id", "turn", "blank", "truncated", "dropped")]
        for conv_id, turn, blank, truncated, dropped, role, text in zip(*plain, as_bytes("role"), as_bytes("text")):
            if current != (conv_id,):
                if current is not None:
                    if opened:
                        yield chunk()
                    else:
                        group.append((current[0], judged(raw)))
                        held += len(raw) + 1
                        raw, size = [], 0
                        if held >= _GROUP_ROWS:
                            yield _done(list(solve(group)))
                            group, held = [], 0
                    opened = False
                current = (conv_id,)
            if dropped:
                continue
            if len(raw) >= chunk_rows or size + len(text) > CHUNK_BYTES and raw:
                opened = True
                yield chunk()
            raw.append((turn, role, text, blank, truncated))
            size += len(text)
    if group:
        yield _done(list(solve(group)))
    if current is not None:  # the last one may go on in the next partition
        yield chunk()


# --- conversations in chunks -------------------------------------------------------------------------------------

_KEYS = ["unnamed", "conv", "chunk"]
_BRIEF = "unnamed boolean, conv long, chunk long, costs array<long>"
_ENDED = "unnamed boolean, conv long, chunk long, rest array<long>"
_PATHS = "unnamed boolean, conv long, chunk long, audits array<string>, ends array<int>"


def _brief_rows(table: pa.Table) -> list[Row]:
    order = np.argsort(table["pos"].to_numpy())
    fields = (table[name].take(pa.array(order)).to_pylist() for name in ("pos", "initial", "is_blank", "is_duplicate", "is_truncated"))
    return [Row(None, b"", b"", lead, blank, again, cut and not blank and not again) for pos, lead, blank, again, cut in zip(*fields) if pos >= 0]


def _keys_of(table: pa.Table) -> list[pa.Array]:
    return [pa.array([table["unnamed"][0].as_py()]), longs([table["conv"][0].as_py()]), longs([table["chunk"][0].as_py()])]


def _border_costs(table: pa.Table) -> pa.Table:
    """Costs between the states at a chunk's borders, from-state by from-state."""
    rows = _brief_rows(table)
    to = [distances(rows, tuple(0 if s == t else NEVER for s in range(4)))[0] for t in range(4)]
    costs = [min(to[t][s], NEVER) for s in range(4) for t in range(4)]
    return pa.Table.from_arrays([*_keys_of(table), pa.array([costs], pa.list_(pa.int64()))], _names(_BRIEF))


def _rest_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost after each chunk, state by state; chunks of a conversation come last first."""
    current, rest = None, END
    for batch in batches:
        rows = []
        for unnamed, conv, chunk, costs in zip(*(column.to_pylist() for column in batch.columns)):
            if current != (unnamed, conv):
                current, rest = (unnamed, conv), END
            rows.append((unnamed, conv, chunk, list(rest)))
            rest = tuple(min(costs[4 * s + t] + rest[t] for t in range(4)) for s in range(4))
        unnamed, conv, chunk, after = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(unnamed, pa.bool_()), longs(conv), longs(chunk), pa.array(after, pa.list_(pa.int64()))], _names(_ENDED))


def _chunk_paths(table: pa.Table) -> pa.Table:
    """A chunk's least audit from each state it may be entered in, and the state that it ends in."""
    rows = _brief_rows(table)
    rest = next(tuple(x) for x in table["rest"].to_pylist() if x is not None)
    costs = np.array(distances(rows, rest))
    letter, target = optimal_arcs([*rows, None], costs, np.array([len(rows)]), closing=False)
    audits, last = ranked_audits(letter, target, np.arange(4))
    arrays = [pa.array([[x.decode() for x in audits]], pa.list_(pa.string())), pa.array([(last % 4).astype(np.int32).tolist()], pa.list_(pa.int32()))]
    return pa.Table.from_arrays([*_keys_of(table), *arrays], _names(_PATHS))


class _Stream:
    """A conversation whose rows pass in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost = conv_id, START, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last_turn = None
        self.before: bytes | None = None
        self.audit: list[bytes] = []
        self._hash, self._any, self._steps, self._at = hashlib.sha256(), False, b"", 0

    def _write(self, role: bytes, text: bytes) -> None:
        self._hash.update((b"\n" if self._any else b"") + role + b":")
        self._hash.update(text)
        self._any = True

    def _inserts(self) -> None:
        while self._at < len(self._steps) and self._steps[self._at] == 73:
            self._write(ASKED[self.state], b"")
            self.state = AFTER[self.state]
            self.cost += INSERT
            self._at += 1

    def enter(self, audits: list[str]) -> None:
        self._inserts()
        self._steps, self._at = audits[self.state].encode(), 0
        self.audit.append(self._steps)

    def row(self, turn, role: bytes, text: bytes, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut = truncated and not blank and not duplicate
        self.truncated += cut
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        letter = first_letter(role)
        if self.before is not None:
            self.illegal += illegal_pairs([self.before, letter])
        self.before = letter
        self._inserts()
        code = self._steps[self._at]
        self._at += 1
        if code == 68:
            self.cost += DELETE
            return
        self.cost += cut * TRUNCATED + (code == 82) * REROLE
        self._write(role if code == 75 else ASKED[self.state], text)
        self.state = SYSTEM if code == 75 and self.state == START and initial(role) == SYSTEM else AFTER[self.state]

    def close(self) -> tuple:
        self._inserts()
        self._steps, self._at = _END_LETTERS[self.state], 0
        self.audit.append(self._steps)
        self._inserts()
        gaps = gap_count(self.least, self.last_turn, self.turns)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, b"".join(self.audit).decode(), self._hash.hexdigest())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose chunks' heads and rows come in order."""
    stream, current = None, None

    def result() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(stream.close(), kinds)], _names(RESULT))

    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        as_bytes = lambda name: columns[name].cast(pa.large_binary()).to_pylist()
        plain = [columns[name].to_pylist() for name in ("unnamed", "conv", "pos", "turn", "is_blank", "is_duplicate", "is_truncated", "audits")]
        for unnamed, conv, pos, turn, blank, again, cut, audits, role, text in zip(*plain, as_bytes("role"), as_bytes("text")):
            if current != (unnamed, conv):
                if stream is not None:
                    yield result()
                stream, current = _Stream(None if unnamed else conv), (unnamed, conv)
            if pos < 0:
                stream.enter(audits)
            else:
                stream.row(turn, role, text, blank, again, cut)
    if stream is not None:
        yield result()


def _in_chunks(opened: DataFrame) -> DataFrame:
    """RESULT for conversations given as chunks."""
    rows = opened.select(
        F.col("conv_id").isNull().alias("unnamed"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), "chunk", "pos", "turn", "role", "text", "is_blank", "is_truncated"
    )
    said = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)
    # Each different saying keeps its first place, combined before the shuffle; every other place is a duplicate.
    first = (
        rows.where("pos >= 0 AND NOT is_blank")
        .groupBy("unnamed", "conv", said.alias("said"))
        .agg(F.min(F.struct("chunk", "pos")).alias("first"))
        .select("unnamed", "conv", "first.chunk", "first.pos", F.lit(True).alias("is_first"))
    )
    brief = rows.select(*_KEYS, "pos", F.left(F.col("role"), F.lit(1)).alias("letter"), "is_blank", "is_truncated")
    marked = materialize(
        brief.join(first, [*_KEYS, "pos"], "left").select(
            *_KEYS,
            "pos",
            F.coalesce(F.when(F.col("letter") == "s", SYSTEM).when(F.col("letter") == "u", USER).when(F.col("letter") == "a", ASSISTANT), F.lit(0)).alias("initial"),
            "is_blank",
            (~F.col("is_blank") & F.col("is_first").isNull()).alias("is_duplicate"),
            "is_truncated",
        ),
        "repair-brief",
    )
    borders = marked.groupBy(*_KEYS).applyInArrow(_border_costs, _BRIEF)
    backwards = borders.repartition("unnamed", "conv").sortWithinPartitions("unnamed", "conv", F.col("chunk").desc())
    rest = materialize(backwards.mapInArrow(_rest_costs, _ENDED), "repair-rest")
    heads = rest.withColumn("pos", F.lit(-1))  # the head carries the cost after the chunk
    paths = materialize(marked.join(heads, [*_KEYS, "pos"], "left").groupBy(*_KEYS).applyInArrow(_chunk_paths, _PATHS), "repair-paths")
    whole = (
        rows.join(marked.select(*_KEYS, "pos", "is_duplicate"), [*_KEYS, "pos"])
        .join(paths.select(*_KEYS, "audits", F.lit(-1).alias("pos")), [*_KEYS, "pos"], "left")
        .select("unnamed", "conv", "chunk", "pos", "turn", "role", "text", "is_blank", "is_duplicate", "is_truncated", "audits")
    )
    return whole.repartition("unnamed", "conv").sortWithinPartitions("unnamed", "conv", "chunk", "pos").mapInArrow(_finish, RESULT)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """RESULT, a row per conversation, from conv_id, turn, role and text; rows marked `dropped` only name their conversation."""
    mixed = materialize(_ordered(rows).mapInArrow(lambda batches: _partition(batches, chunk_rows), _MIXED), "repair")
    names = _names(RESULT)
    return mixed.where("NOT open").select(names).unionByName(_in_chunks(mixed.where("open")).select(names))
