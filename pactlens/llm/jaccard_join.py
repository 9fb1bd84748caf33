"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of `percent` or more, exactly.

A document's set: A-Z lower-cased, words cut at ASCII white space, distinct shingles of `width` words; fewer words make one
shingle of all of them; without words the set is empty and linked with nothing. Shingles are compared by 64-bit hashes.
Equal sets form one class first (a digest names it, a second one tells if two sets share a name: then another seed is taken).

Universe partition. Sizes are cut into bands. For two sets with sizes a >= b, at most H(a, b) = (a + b)(100 - p) / (100 + p)
shingles are in one only. A band has as many segments as the largest H of its sizes + 1, and every shingle is hashed to
one. The shingles of a set in a segment are a subset; its signature is a sum of hashes, so that leaving one shingle out costs
a subtraction. Sets are indexed under their own band and look up that band and those below that may hold a partner.

Pigeonhole. A set gives each segment a level: 0 is not looked up; 1 finds equal subsets; 2 finds subsets that differ by one
shingle too, through the one-deletion neighbourhoods of both sides (kept for the first segments of a band). When the levels'
sum passes H, a partner must show at some segment. Costs come from the whole corpus: a shuffle by signature counts what a
lookup would meet. Lookups that meet nothing are free; only where they do not reach H + 1 are others taken, cheapest first. Most
sets need none and are done.

Verification. Sets that may meet form groups (components over shared signatures). A group of at most LEAF sets is one task's:
it looks up, drops pairs already connected, and counts common shingles of the rest exactly. In a larger group, held together by
chance meetings, each signature is first cut into the components of those members that can be similar by their sketches: a
bit per slot, the parity of the shingles there, so that two sets differ by at least as many shingles as their sketches by bits.
The group falls apart into smaller ones, before any text is fetched. One that stays larger is taken signature by signature; a
signature with more than LEAF sets is cut along the distance to a pivot set (the one that shares most): sets
linked to the pivot need no comparison with each other, and blocks whose distances differ by more than a link allows are
not compared (Jaccard distance is a metric). So no task holds more than two blocks, no pairs are written, only links of a
spanning forest. Components come from star contraction. Sides that grow with the corpus are joined by sort and merge at every
size, never broadcast.

Defined results: a null text has no words; a null doc_id keeps its row and names a component only where all members lack one;
repeated rows stay repeated; a very long text is hashed in blocks of a megabyte and its set is held by one task at a time; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import ids_and_text, longs, signed, texts
from pactlens.llm.simhash import _runs, components
from pactlens.session import materialize

BAND_GROWTH = 1.5  # largest by smallest size of a band
NEIGHBOURS = 32  # one segment in so many has one-deletion neighbourhoods
LEAF, LEAF_SHINGLES = 4096, 4_000_000  # of a group that one task compares
HOLD = 1 << 16  # rows of a signature that are counted before they are passed on
_KNOWN = 340_000  # words a worker remembers; a dictionary of over 349,525 takes twice the room
_BLOCK = 1 << 20
_BINS = 20  # steps of distance to a pivot
_SKETCH_BITS = 64, 8192  # least and most of a sketch
_NARROWED = 1 << 14  # rows of a signature whose sketches are compared

INDEXED, LOOKED_UP, INDEXED_LESS_ONE, LOOKED_UP_LESS_ONE = range(4)  # the last two bits of a key


# --- sets --------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return found


_word_hashes = functools.cache(WordHashes)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(text: bytes) -> Iterator[bytes]:
    """Parts of a text that end where a word ends."""
    begin = 0
    while begin < len(text):
        edge = _BREAK.search(text, begin + _BLOCK)
        end = edge.start() if edge else len(text)
        yield text[begin:end]
        begin = end


def shingle_set(text: bytes, width: int = 4, seed: int = 0) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    known = _word_hashes(seed).__getitem__
    carry, parts = np.zeros(0, np.uint64), []
    for block in _blocks(text.lower()):  # bytes: lowers A-Z only
        words = block.split()
        hashes = np.concatenate([carry, np.fromiter(map(known, words), np.uint64, len(words))])
        if len(hashes) >= width:
            parts.append(np.unique(_folded([hashes[n : len(hashes) - width + 1 + n] for n in range(width)])))
            carry = hashes[len(hashes) - width + 1 :]
        else:
            carry = hashes
    if not parts:
        return _folded([carry[n : n + 1] for n in range(len(carry))])
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _folded(words: list[np.ndarray]) -> np.ndarray:
    """One hash of each sequence of words, given word by word."""
    if not words:
        return np.zeros(0, np.uint64)
    found = np.full(len(words[0]), 0x9E3779B97F4A7C15 * len(words) & (1 << 64) - 1, np.uint64)
    for word in words:
        found = mix(found * np.uint64(0xD6E8FEB86659FD93) + word)
    return found


# --- bands, segments and signatures ------------------------------------------------------------------------------


def difference(a: int, b: int, percent: int) -> int:
    """Most shingles that are in one of two similar sets only."""
    return (a + b) * (100 - percent) // (100 + percent)


class Band(NamedTuple):
    number: int
    low: int
    high: int
    segments: int
    neighbours: int  # the first so many segments have one-deletion neighbourhoods


@functools.cache
def bands(percent: int, largest: int) -> tuple[Band, ...]:
    """The bands up to that of size `largest`."""
    found, low = [], 1
    while not found or found[-1].high < largest:
        high = max(low, int(low * BAND_GROWTH))
        segments = difference(100 * high // percent, high, percent) + 1
        found.append(Band(len(found), low, high, segments, max(1, segments // NEIGHBOURS)))
        low = high + 1
    return tuple(found)


def bands_of(size: int, percent: int) -> list[Band]:
    """The band of a size, then those below that may hold a similar set."""
    known = bands(percent, 1 << (size - 1).bit_length())
    own = next(n for n, band in enumerate(known) if band.high >= size)
    return [band for band in known[own::-1] if 100 * band.high >= percent * size]


_SIGNATURE_BITS = 46  # signatures that agree by chance only cost a comparison
_PLACES = 64  # a place is segment x 64 + how many bands below the own one


def signatures(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a signature and two bits of kind) and places of one set."""
    keys, places = [], []
    for below, band in enumerate(bands_of(len(hashes), percent)):
        if band.segments == 1:
            continue  # only equal sets are similar here
        segment = ((hashes >> np.uint64(17)) % np.uint64(band.segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, mixed = segment[order], mix(hashes[order] + np.uint64(band.number + 1))
        edges = np.searchsorted(segment, np.arange(band.segments + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        salt = (np.arange(band.segments).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band.number)
        whole = sums[edges[1:]] - sums[edges[:-1]] + salt
        near = slice(0, edges[band.neighbours])
        less_one = whole[segment[near]] - mixed[near]
        kind = LOOKED_UP if below else INDEXED
        keys += [mix(part) >> np.uint64(64 - _SIGNATURE_BITS) << np.uint64(2) | np.uint64(code) for part, code in ((whole, kind), (less_one, kind + 2))]
        places += [np.arange(band.segments) * _PLACES + below, segment[near] * _PLACES + below]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(places)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the shingles in as many slots as there are shingles or more, in words; half as many slots are `folded` ones."""
    least, most = _SKETCH_BITS
    slots = min(max(1 << (len(hashes) - 1).bit_length(), least), most)
    held = np.bincount(((hashes >> np.uint64(40)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch in `width` words."""
    return np.bitwise_xor.reduce(words.reshape(-1, width))


_MARKED = "doc_id long, said long, n long, cid long, twin long, keys array<long>, places array<int>, sketch binary"


def _marker(width: int, percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: a copy's keys are those of its first text
        for batch in batches:
            sizes, cids, twins, keys, places, ends, sketches = [], [], [], [], [], [0], []
            for text in texts(batch):
                hashes = shingle_set(text, width, seed)
                raw = hashes.tobytes()
                cid = xxhash.xxh3_64_intdigest(raw, seed)
                sizes.append(len(hashes))
                cids.append(cid)
                twins.append(xxhash.xxh64_intdigest(raw, seed))
                ends.append(ends[-1])
                sketches.append(None)
                if len(hashes) and cid not in seen:
                    seen.add(cid)
                    key, place = signatures(hashes, percent)
                    keys.append(key)
                    places.append(place)
                    ends[-1] += len(key)
                    sketches[-1] = sketch(hashes).tobytes()
            unsigned = lambda x: longs(signed(np.array(x, np.uint64)))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            where = np.concatenate(places) if places else np.zeros(0, np.int64)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("said"),
                    longs(sizes),
                    unsigned(cids),
                    unsigned(twins),
                    pa.ListArray.from_arrays(offsets, longs(signed(flat))),
                    pa.ListArray.from_arrays(offsets, pa.array(where.astype(np.int32))),
                    pa.array(sketches, pa.binary()),
                ],
                _names(_MARKED),
            )

    return run


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _said(documents: DataFrame) -> DataFrame:
    return ids_and_text(documents).withColumn("said", F.xxhash64("text"))


# --- what a lookup meets -----------------------------------------------------------------------------------------

_SHARED = "sig long, kind int, cid long, place int, meets long, meets_more long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key and cid, whose signature another set has too, with the numbers of rows that a lookup meets.

    `meets` counts equal subsets, `meets_more` those of which one shingle was left out. A signature with more than HOLD rows is
    passed on in parts, with the numbers so far.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    before: tuple[int, np.ndarray] | None = None  # a signature of which rows were passed on, and its numbers by kind

    def emit(key: np.ndarray, cid: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal before
        sig, kind = key >> 2, key & 3
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1])
        run = np.zeros(len(sig), np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        numbers = np.stack([np.bincount(run, kind == k, len(starts)) for k in range(4)], axis=1).astype(np.int64)
        several = np.minimum.reduceat(cid, starts) != np.maximum.reduceat(cid, starts)
        if before is not None and sig[0] == before[0]:
            numbers[0] += before[1]
            several[0] = True
        before = (int(sig[-1]), numbers[-1])
        met = several & ((numbers[:, INDEXED] > 0) | (numbers[:, INDEXED_LESS_ONE] > 0) & (numbers[:, LOOKED_UP] > 0))
        keep = met[run]
        if keep.any():
            run, sig, kind = run[keep], sig[keep], kind[keep]
            meets = numbers[run, INDEXED] - (kind == INDEXED)
            more = np.where(kind < INDEXED_LESS_ONE, numbers[run, INDEXED_LESS_ONE], 0)
            arrays = [longs(sig), pa.array(kind.astype(np.int32)), longs(cid[keep]), pa.array(place[keep]), longs(meets), longs(more)]
            yield pa.RecordBatch.from_arrays(arrays, _names(_SHARED))

    for batch in batches:
        held = [np.concatenate([x, np.asarray(column.to_numpy())]) for x, column in zip(held, batch.columns)]
        new = np.ones(len(held[0]), bool)  # copies in other tasks give equal rows
        new[1:] = (np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)
        held = [x[new] for x in held]
        sig = held[0] >> 2
        if len(sig):
            last = int(np.searchsorted(sig, sig[-1]))  # the rows of the last signature may go on
            cut = len(sig) - 1 if len(sig) - last > HOLD else last  # one row stays to be compared with the next batch
            if cut:
                yield from emit(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from emit(*held)


# --- allocation --------------------------------------------------------------------------------------------------

_ALLOCATED = "sig long, cid long, n long, kind int, level int"


def allocate(size: int, place: np.ndarray, kind: np.ndarray, meets: np.ndarray, more: np.ndarray, percent: int) -> np.ndarray:
    """The level of each row of one set: of its segment for a whole subset, 1 or 0 for a subset less one."""
    levels = np.zeros(len(place), np.int64)
    for below, band in enumerate(bands_of(size, percent)):
        rows = np.flatnonzero(place % _PLACES == below)
        if not len(rows):
            continue
        segments, at = np.unique(place[rows] // _PLACES, return_inverse=True)
        at = at.ravel()
        whole = kind[rows] < INDEXED_LESS_ONE
        first = np.bincount(at, np.where(whole, meets[rows], 0), len(segments))
        extra = np.bincount(at, np.where(whole, more[rows], meets[rows]), len(segments))
        near = np.flatnonzero(segments < band.neighbours)
        # Segments that meet nothing count for free, twice where they have neighbourhoods.
        wanted = difference(size, min(size, band.high), percent) + 1
        wanted -= band.segments - len(segments) + band.neighbours - len(near)
        if wanted <= 0:
            continue
        cost = np.concatenate([first, np.maximum(first, extra)[near]])
        unit = np.concatenate([np.arange(len(segments)), near])
        chosen = np.bincount(unit[np.argsort(cost, kind="stable")[:wanted]], minlength=len(segments))
        levels[rows] = np.where(whole, chosen[at], chosen[at] == 2)
    return levels


def _allocator(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("cid",)):
            levels = allocate(int(rows["n"][0]), rows["place"].astype(np.int64), rows["kind"], rows["meets"], rows["meets_more"], percent)
            stay = (rows["kind"] % 2 == 0) | (levels > 0)  # a row that only looks up goes when it does not
            arrays = [longs(rows["sig"][stay]), longs(rows["cid"][stay]), longs(rows["n"][stay])]
            arrays += [pa.array(rows["kind"][stay].astype(np.int32)), pa.array(levels[stay].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, _names(_ALLOCATED))

    return run


# --- groups ------------------------------------------------------------------------------------------------------


def near_parts(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one of its component, over the pairs that can be similar by sizes and sketches."""
    width = min(map(len, sketches))
    words = np.stack([folded(one, width) for one in sketches])
    first, rest = np.arange(len(sizes)), np.arange(len(sizes))
    while len(rest):
        start, rest = int(rest[0]), rest[1:]
        reached = [start]
        while reached and len(rest):
            x = reached.pop()
            apart = np.bitwise_count(words[rest] ^ words[x]).sum(axis=1, dtype=np.int64)
            near = apart <= (sizes[rest] + sizes[x]) * (100 - percent) // (100 + percent)
            near &= 100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])
            first[rest[near]] = start
            reached += rest[near].tolist()
            rest = rest[~near]
    return first


def _narrower(percent: int, most: int):
    """Rows of signatures (sorted by sig, cid) with one signature for each part of several sets; sets alone in theirs are left out.

    A signature with more than `most` rows stays whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        whole = None  # a signature that stays

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows, held = held, []
            if not rows:
                return
            sets: dict[int, int] = {}
            place = np.array([sets.setdefault(row["cid"], len(sets)) for row in rows])
            if rows[0]["sig"] != whole:
                if len(sets) == 1:
                    return
                lone = dict(zip(place.tolist(), rows))
                sketches = [np.frombuffer(lone[n]["sketch"], np.uint64) for n in range(len(sets))]
                first = near_parts(np.array([lone[n]["n"] for n in range(len(sets))]), sketches, percent)
                kept = np.flatnonzero(np.bincount(first, minlength=len(sets))[first[place]] > 1)
                names = mix(np.array([rows[n]["sig"] for n in kept], np.int64).view(np.uint64) + first[place[kept]].astype(np.uint64))
                rows = [rows[n] | {"sig": name} for n, name in zip(kept, signed(names).tolist())]
            if rows:
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array([row[x] for row in rows], kind) for x, kind in zip(_names(_ALLOCATED), kinds)], _names(_ALLOCATED))

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["sig"] != row["sig"]:
                    yield from close()
                held.append(row)
                if len(held) > most:
                    whole = row["sig"]
                    yield from close()
        yield from close()

    return run


def _groups(allocated: DataFrame, classes: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Rows of signatures that are looked up and hold two sets or more, and the group of each of their sets (cid, root, n, at, small)."""
    met = allocated.groupBy("sig").agg(F.min("cid").alias("hub"), F.max("cid").alias("other"), F.max("level").alias("most")).where("most > 0 AND hub <> other")
    linked = materialize(allocated.join(met.select("sig", "hub").hint("merge"), "sig"), "jaccard-met")
    groups = components(linked.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    allocated = linked.drop("hub")
    members = allocated.select("cid").distinct().join(groups, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root"))
    grouped = members.join(classes.select("cid", "n", "at"), "cid")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).select("root", _small(leaf).alias("small"))
    return allocated, materialize(grouped.join(sizes, "root"), "jaccard-groups")


def _narrowed(allocated: DataFrame, grouped: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """The rows of large groups, their signatures cut by sketches."""
    wanted = grouped.where("NOT small").select("cid")
    sketches = marked.where("sketch IS NOT NULL").select("cid", "sketch").join(wanted, "cid", "left_semi").dropDuplicates(["cid"])
    rows = allocated.join(sketches.hint("merge"), "cid").repartition("sig").sortWithinPartitions("sig", "cid")
    return materialize(rows.mapInArrow(_narrower(percent, _NARROWED), _ALLOCATED), "jaccard-narrowed")


# --- verification ------------------------------------------------------------------------------------------------


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Unit(NamedTuple):
    """Sets that one task compares: `rows` are (member, signature, kind, level)."""

    cids: np.ndarray
    sides: np.ndarray
    sets: list[np.ndarray]
    rows: np.ndarray

    def links(self, percent: int, two_sides: bool) -> list[tuple[int, int]]:
        """Links (positions) of a spanning forest of the similar pairs; with `two_sides` pairs have one of each."""
        sizes = np.array([len(x) for x in self.sets])
        starts = np.cumsum(sizes) - sizes
        _, token = np.unique(np.concatenate(self.sets), return_inverse=True)
        token = token.ravel()
        marks = np.zeros(int(token.max(initial=0)) + 1, np.int64)
        rows = self.rows[np.argsort(self.rows[:, 1], kind="stable")]
        member, kind, level = rows[:, 0], rows[:, 2], rows[:, 3]
        _, first, run = np.unique(rows[:, 1], return_index=True, return_inverse=True)
        run, last = run.ravel(), np.append(first[1:], len(rows))
        indexed = [member[a:b][kind[a:b] == INDEXED] for a, b in zip(first, last)]
        less_one = [member[a:b][kind[a:b] == INDEXED_LESS_ONE] for a, b in zip(first, last)]
        label, found = np.arange(len(sizes)), []
        looks = np.flatnonzero(level > 0)
        looks = looks[np.argsort(member[looks], kind="stable")]
        edges = np.searchsorted(member[looks], np.arange(len(sizes) + 1))
        for x in range(len(sizes)):
            met = np.zeros(len(sizes), bool)
            for row in looks[edges[x] : edges[x + 1]]:
                met[indexed[run[row]]] = True
                if level[row] == 2:
                    met[less_one[run[row]]] = True
            met &= (label != label[x]) & (sizes <= sizes[x]) & (100 * sizes >= percent * sizes[x])
            if two_sides:
                met &= self.sides != self.sides[x]
            others = np.flatnonzero(met)
            if not len(others):
                continue
            own = token[starts[x] : starts[x] + sizes[x]]
            marks[own] = 1
            common = np.add.reduceat(marks[token[_ragged(starts[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others])
            marks[own] = 0
            for y in others[100 * common >= percent * (sizes[x] + sizes[others] - common)]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    found.append((x, int(y)))
        return found


_UNIT = ["unit", "a", "b"]


def _verifier(percent: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            held[:] = [row for row in held if row[2] is not None and row[3] is not None]
            if len(held) > 1:
                cids = np.array([row[0] for row in held])
                rows = [np.column_stack([np.full(len(sig), n), sig, kind, level]) for n, (_, _, _, sig, kind, level) in enumerate(held)]
                unit = Unit(cids, np.array([row[1] for row in held]), [np.frombuffer(row[2], np.uint64) for row in held], np.concatenate(rows))
                if found := unit.links(percent, current[1] != current[2]):
                    x, y = np.array(found).T
                    yield pa.RecordBatch.from_arrays([longs(cids[x]), longs(cids[y])], ["a", "b"])

        current, held = None, []
        for batch in batches:
            columns = (batch.column(n).cast(pa.large_binary()) if name == "text" else batch.column(n) for n, name in enumerate(batch.schema.names))
            for unit, a, b, cid, side, text, hashes, sig, kind, level in zip(*(column.to_pylist() for column in columns)):
                if current != (unit, a, b):
                    yield from close()
                    current, held = (unit, a, b), []
                if not held or held[-1][:2] != [cid, side]:
                    held.append([cid, side, None, None, None, None])
                if text is not None and held[-1][2] is None:  # else one text on several rows
                    raw = shingle_set(text, width, seed).tobytes()
                    hashes = raw if xxhash.xxh3_64_intdigest(raw, seed) == cid & (1 << 64) - 1 else None
                if hashes is not None:
                    held[-1][2] = hashes
                if sig is not None:
                    held[-1][3:] = sig, kind, level
        yield from close()

    return run


def _compared(units: DataFrame, percent: int, width: int, seed: int) -> DataFrame:
    """Links of units; rows of their members: unit, a, b, cid, side, text or hashes, sigs, kinds, levels, the set and the
    lookups in one row or in two."""
    dealt = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "cid")
    return dealt.mapInArrow(_verifier(percent, width, seed), "a long, b long")


def _to_pivot(percent: int):
    """For members of a hot signature: whether they are linked to its pivot, and the step of their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {name: [np.frombuffer(x, np.uint64) for x in batch.column(name).to_pylist()] for name in ("hashes", "pivot_hashes")}
            linked, steps = [], []
            for one, two in zip(*sets.values()):
                common = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - common
                linked.append(100 * common >= percent * union)
                steps.append(_BINS * (union - common) // union)
            arrays = [batch.column("sig"), batch.column("cid"), batch.column("pivot"), pa.array(linked, pa.bool_()), pa.array(steps, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["sig", "cid", "pivot", "linked", "step"])

    return run


def _hot_links(hot: DataFrame, rows: DataFrame, sets: DataFrame, percent: int, leaf: int, width: int, seed: int) -> DataFrame:
    """Links among the sets of signatures that are too large for one task (sig, members, shingles)."""
    shares = rows.groupBy("cid").agg(F.count("*").alias("shares"))
    pivots = rows.join(hot, "sig").join(shares, "cid").groupBy("sig").agg(F.max_by("cid", F.struct("shares", "cid")).alias("pivot"))
    beside = pivots.join(sets.select(F.col("cid").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot")
    members = rows.join(hot.select("sig"), "sig", "left_semi").select("sig", "cid").distinct()
    measured = materialize(
        members.join(sets, "cid").join(beside, "sig").select("sig", "cid", "hashes", "pivot", "pivot_hashes").mapInArrow(_to_pivot(percent), "sig long, cid long, pivot long, linked boolean, step int"),
        "jaccard-pivots",
    )
    parts = F.greatest(F.ceil(F.col("members") * 2 / leaf), F.ceil(F.col("shingles") * 2 / LEAF_SHINGLES))
    placed = measured.join(hot, "sig").select("sig", "cid", "linked", "step", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"))
    # A block's number: linked or not, step, part.
    placed = placed.withColumn("block", (F.col("part").cast("long") * 2 * (_BINS + 1)) + F.col("step") * 2 + F.col("linked").cast("int"))
    blocks = placed.select("sig", "block", "linked", "step").distinct()
    one, two = blocks.alias("one"), blocks.alias("two")
    apart = (F.abs(F.col("one.step") - F.col("two.step")) - 1) * 100 > (100 - percent) * _BINS
    pairs = one.join(two, (F.col("one.sig") == F.col("two.sig")) & (F.col("one.block") <= F.col("two.block")) & ~(F.col("one.linked") & F.col("two.linked")) & ~apart)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("one.block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("two.block").alias("block")))
    sides = F.when(F.col("one.block") == F.col("two.block"), F.slice(sides, 1, 1)).otherwise(sides)
    dealt = pairs.select(F.col("one.sig").alias("sig"), F.col("one.block").alias("a"), F.col("two.block").alias("b"), F.explode(sides).alias("s")).select("sig", "a", "b", "s.side", "s.block")
    entries = rows.groupBy("sig", "cid").agg(*_lists())
    units = dealt.join(placed.select("sig", "block", "cid"), ["sig", "block"]).join(entries, ["sig", "cid"]).join(sets, "cid")
    units = units.select(F.col("sig").alias("unit"), "a", "b", "cid", "side", F.lit(None).cast("string").alias("text"), "hashes", "sigs", "kinds", "levels")
    linked = measured.where("linked AND cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    return linked.unionByName(_compared(units, percent, width, seed))


def _lists():
    entry = F.collect_list(F.struct("sig", "kind", "level"))
    return [entry.getField(name).alias(name + "s") for name in ("sig", "kind", "level")]


def _members(frame: DataFrame, unit: str) -> DataFrame:
    """Rows of units that are whole groups or signatures; `frame` may lack the set, or the lookups."""
    zero, missing = F.lit(0).cast("long"), {"text": "string", "hashes": "binary", "sigs": "array<long>", "kinds": "array<int>", "levels": "array<int>"}
    rest = [F.col(name) if name in frame.columns else F.lit(None).cast(kind).alias(name) for name, kind in missing.items()]
    return frame.select(F.col(unit).alias("unit"), zero.alias("a"), zero.alias("b"), "cid", F.lit(0).alias("side"), *rest)


def _hashed(width: int, seed: int):
    """The sets of texts, for those that are the set named by cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, width, seed).tobytes() for text in texts(batch)]
            named = [xxhash.xxh3_64_intdigest(raw, seed) == cid & (1 << 64) - 1 for raw, cid in zip(sets, batch.column("cid").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "hashes"]).filter(pa.array(named, pa.bool_()))

    return run


def links(documents: DataFrame, allocated: DataFrame, grouped: DataFrame, percent: int, leaf: int, width: int, seed: int) -> DataFrame:
    """Links (a, b) between cids; `grouped` has the group of each cid (cid, root, n, at, small). Both have the `turn` of
    grouping, 0 or 1, that counts; large groups are left in the second only."""
    wanted = grouped.select("cid", "root", "small", F.col("at.doc_id").alias("id"), F.col("at.said").alias("as_said"))
    placed = allocated.join(grouped.select("cid", "turn", "root", "small").hint("merge"), ["cid", "turn"])
    lookups = placed.where("small").groupBy("root", "cid").agg(*_lists())
    members = _members(_texts_of(documents, wanted.where("small")), "root").unionByName(_members(lookups, "root"))
    found = _compared(members, percent, width, seed)
    if grouped.where("NOT small").isEmpty():
        return found
    large = materialize(placed.where("turn = 1 AND NOT small").select("sig", "cid", "n", "kind", "level"), "jaccard-large")
    sets = _texts_of(documents, wanted.where("NOT small")).select("cid", "text").mapInArrow(_hashed(width, seed), "cid long, hashes binary")
    sets = materialize(sets.dropDuplicates(["cid"]), "jaccard-hashes")
    sizes = large.groupBy("sig").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.max("level").alias("most")).where("members > 1 AND most > 0").drop("most")
    sizes = materialize(sizes, "jaccard-signatures")
    each = large.join(sizes.where(_small(leaf)).select("sig"), "sig", "left_semi").groupBy("sig", "cid").agg(*_lists()).join(sets, "cid")
    found = found.unionByName(_compared(_members(each, "sig"), percent, width, seed))
    hot = sizes.where(~_small(leaf))
    if hot.isEmpty():
        return found
    return found.unionByName(_hot_links(hot, large, sets, percent, leaf, width, seed))


def _small(leaf: int) -> Column:
    return (F.col("members") <= leaf) & (F.col("shingles") <= LEAF_SHINGLES)


_FILTER_BITS = 1 << 26


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (id, as_said and more) with the texts of the documents that they name.

    A bit map of fixed size (2**20 words of 64 bits, so it may be broadcast) spares most other texts the shuffle.
    """

    def bits(said: str) -> tuple[Column, Column]:
        slot = F.pmod(F.col(said), F.lit(_FILTER_BITS))
        return F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod({said}, 64) AS INT))").alias("bit")

    held = wanted.select(*bits("as_said")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    likely = _said(documents).select("*", *bits("said")).join(F.broadcast(held), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    likely = likely.select("doc_id", "said", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("said") == F.col("as_said")))
    return likely.select("cid", "root", "text")


def similar(documents: DataFrame, percent: int = 85, width: int = 4, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row."""
    seed = 0
    while True:
        marked = materialize(_said(documents).mapInArrow(_marker(width, percent, seed), _MARKED), "jaccard-sets", compression="zstd")
        least, most = F.min(F.struct("n", "twin")), F.max(F.struct("n", "twin"))
        named = marked.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "said")).alias("at"), least.alias("least"), most.alias("most"))
        classes = materialize(named.select("cid", "first_id", "at", F.col("least.n").alias("n"), (F.col("least") == F.col("most")).alias("one_set")), "jaccard-classes")
        if classes.where("NOT one_set").isEmpty():
            break
        seed += 1
    rows = marked.where("size(keys) > 0").select("cid", F.explode(F.arrays_zip("keys", "places")).alias("x")).select(F.col("x.keys").alias("key"), "cid", F.col("x.places").alias("place"))
    shared = rows.repartition(F.shiftright("key", 2)).sortWithinPartitions("key", "cid").mapInArrow(_shared, _SHARED)
    shared = materialize(shared, "jaccard-shared", compression="zstd")
    sized = shared.join(classes.select("cid", "n").hint("merge"), "cid").repartition("cid").sortWithinPartitions("cid")
    allocated = materialize(sized.mapInArrow(_allocator(percent), _ALLOCATED), "jaccard-lookups")

    rows, grouped = _groups(allocated, classes, leaf)
    turn = [F.lit(n).alias("turn") for n in range(2)]
    allocated, groups = rows.select("*", turn[0]), grouped.where("small").select("*", turn[0])
    if not grouped.where("NOT small").isEmpty():
        near, near_grouped = _groups(_narrowed(rows, grouped, marked, percent), classes, leaf)
        allocated, groups = allocated.unionByName(near.select("*", turn[1])), groups.unionByName(near_grouped.select("*", turn[1]))

    roots = components(links(documents, allocated, groups, percent, leaf, width, seed))
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "first_id", F.coalesce("root", "cid").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = placed.join(named, "root").select("cid", "component_id")
    full = marked.where("n > 0").join(members, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
