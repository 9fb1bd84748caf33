"""Repeated passages: removes each byte of a string of `length` bytes that also starts in a document with a smaller id.

Repeats are found by suffixes: collections of strings are cut into shards, each shard's Burrows-Wheeler transform is built, and
the transforms are merged by refining their interleave. Pass h stably deals interleaved rows by the symbol before
them, which orders all suffixes by their first h symbols without sorting them again, and marks where neighbours part, which
is their common prefix; rows of intervals that have not parted in the pass before stay as they are. After `length` passes the rows between two marks are one repeated interval: the
places of one string of that length. The smallest document id of an interval decides for all of its places.

So that no task holds more than a part, equal strings must first come together. Each window of `length` bytes is named by its
anchor, the substring of `anchor` bytes with the smallest hash in it; equal windows have equal anchors. Neighbouring windows
of one anchor form a run, a short string. Only anchors that occur in two documents can matter:

1. Texts are packed in batches of a few megabytes, compressed, exchanged once and written in buckets by batch number, so that no
   later step exchanges them again. A batch never splits a document.
2. Each batch sends its distinct anchors, packed by bucket; a bucket answers each batch with the anchors that are shared.
3. Each batch sends its distinct strings of shared anchors, packed by bucket, with the smallest id that holds each. An anchor
   of a hot passage costs a batch one row, however many documents hold it. An anchor in very many batches may have
   more strings than a task should hold: its windows are sent one by one to buckets of their own hash instead.
4. A bucket merges the transforms of the strings that share an anchor and answers each batch with the smallest id of each window.
   A string that is alone with its anchor has the same places for all of its windows and needs no merge.
5. Each batch finds the places of its strings again, rather than keep them on disk meanwhile, and marks the bytes to remove.

All exchanges are keyed by bucket or batch, both of bounded size, so no hot document, passage or source gathers in one task.

Defined results: a null text is empty. Texts are bytes of UTF-8; where a removal splits a character, `kept_text` drops its
remaining bytes. A row without a doc_id counts as larger than all others and equal ids do not remove each other, so
repeated rows of one id all stay. A very long text is a batch of its own, held by one task with arrays of about thirty times
its size. An empty table gives an empty result. Other columns, whatever their names, are ignored, or carried along in `row`.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pactlens.llm.common import ids_and_text, longs, materialize_in_buckets, texts
from pactlens.session import materialize

LENGTH, ANCHOR = 50, 20
BATCH = 4 << 20  # bytes of text in a batch
BUCKET = 16 << 20  # bytes of text for each bucket
HOT = 1000  # batches from which on an anchor's windows are dealt one by one
SHARDS = 4  # of a collection
COLLECTION = 1 << 16  # bytes of strings that are merged at once
_CHUNK, _PART, _LONGEST_RUN = 1 << 18, 1 << 16, 200
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_KEY_BITS = 48


# --- texts in batches --------------------------------------------------------------------------------------------


def _zip(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays end to end, each behind its length, compressed."""
    parts = []
    for array in arrays:
        raw = array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes()
        parts += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def _unzip(raw: bytes, *kinds: str | None) -> list:
    raw, at, found = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + size]
        found.append(part if kind is None else np.frombuffer(part, kind))
        at += 8 + size
    return found


NO_ID = 2**63 - 1


def batches_of(documents: DataFrame, batch_bytes: int = BATCH, with_rows: bool = False) -> DataFrame:
    """batch, n_bytes and packed: ids, which ids and texts are null, lengths and texts of a few documents.

    `with_rows` adds `rows`, all columns but the text, as an Arrow stream.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, missing, parts, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            nulls = np.array([(i is None) + 2 * none for i, none in zip(ids, missing)], np.uint8)
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            packed = _zip(known, nulls, np.array([len(t) for t in held], np.int64), b"".join(held), level=3)
            columns = [longs([number]), longs([size]), pa.array([packed], pa.binary())]
            if with_rows:
                columns.append(pa.array([_zip(_stream(pa.Table.from_batches(parts)), level=3)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["batch", "n_bytes", "packed", "rows"][: len(columns)])

        for batch in batches:
            rest, begin = batch.select(["row"]) if with_rows else None, 0
            none = batch.column("text").is_null().to_pylist()
            for n, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts(batch)), start=1):
                ids.append(doc_id)
                held.append(text)
                missing.append(none[n - 1])
                size += len(text)
                if size >= batch_bytes or len(ids) >= batch_bytes // 16:
                    if with_rows:
                        parts.append(rest.slice(begin, n - begin))
                        begin = n
                    yield row()
                    ids, held, missing, parts, size, number = [], [], [], [], 0, number + 1
            if with_rows:
                parts.append(rest.slice(begin))
        if ids:
            yield row()

    read = ids_and_text(documents)
    if with_rows:
        others = [F.col(f"`{name}`") for name in documents.columns if name != "text"]
        read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))
    return read.mapInArrow(pack, "batch long, n_bytes long, packed binary" + ", rows binary" * with_rows)


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


class Batch:
    def __init__(self, packed: bytes):
        self.ids, self.nulls, self.lengths, self.text = _unzip(packed, "<i8", "u1", "<i8", None)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.values = np.frombuffer(self.text, np.uint8)


# --- anchors -----------------------------------------------------------------------------------------------------


def _window_minima(values: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For each window of `length` bytes, the smallest hash of its substrings of `anchor` bytes."""
    with np.errstate(over="ignore"):
        powers = {1: (values.astype(np.uint64) + np.uint64(1), _MULTIPLIER)}
        size = 1
        while size * 2 <= anchor:
            h, p = powers[size]
            powers[size * 2] = (h[:-size] * p + h[size:], p * p)
            size *= 2
        whole, done = powers[size][0], size
        while done < anchor:
            size //= 2
            if done + size <= anchor:
                h, p = powers[size]
                whole = whole[: len(h) - done] * p + h[done:]
                done += size
        whole ^= whole >> np.uint64(29)
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        whole ^= whole >> np.uint64(32)
    width, reach = length - anchor + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        whole = np.minimum(whole[:-step], whole[step:])
        reach += step
    return whole


def runs(batch: Batch, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, key and document of each run of neighbouring windows with one anchor."""
    n = len(batch.values)
    inside = np.ones(n, bool)
    for start, end in zip(batch.starts.tolist(), batch.ends.tolist()):
        inside[max(start, end - length + 1) : end] = False
    document = np.repeat(np.arange(len(batch.lengths), dtype=np.int32), batch.lengths)
    found = []
    for at in range(0, n - length + 1, _CHUNK):
        minima = _window_minima(batch.values[at : at + _CHUNK + length - 1], length, anchor)
        valid, doc = inside[at : at + len(minima)], document[at : at + len(minima)]
        new = np.ones(len(minima), bool)
        new[1:] = (minima[1:] != minima[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(minima)))
        if count.max() > _LONGEST_RUN:
            pieces = -(-count // _LONGEST_RUN)
            order = np.repeat(np.arange(len(start)), pieces)
            nth = np.arange(len(order)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, count = start[order] + nth * _LONGEST_RUN, np.minimum(count[order] - nth * _LONGEST_RUN, _LONGEST_RUN)
        kept = valid[start]
        start, count = start[kept], count[kept]
        with np.errstate(over="ignore"):
            key = (minima[start] * _MULTIPLIER) >> np.uint64(64 - _KEY_BITS)
        found.append((start + at, count, key, doc[start]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    whole = np.zeros((len(raw) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return whole.view("<u8").reshape(-1)


def _binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _send_anchors(rows: Iterator[pa.RecordBatch], buckets: int, length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for part in rows:
        for number, packed in zip(part.column("batch").to_pylist(), part.column("packed").to_pylist()):
            _, _, key, doc = runs(Batch(packed), length, anchor)
            order = np.lexsort((key, key % np.uint64(buckets)))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            if not len(first):
                continue
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            key = key[first]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    longs([int(bucket[a]) for a, _ in spans]), longs([number] * len(spans)),
                    _binaries([_six(key[a:b][several[a:b]]) for a, b in spans]), _binaries([_six(key[a:b][~several[a:b]]) for a, b in spans]),
                ],
                ["bucket", "batch", "several", "one"],
            )


def _shared_anchors(table: pa.Table, hot: int) -> pa.Table:
    """To each batch, which of its anchors in this bucket occur in two documents, and which of these in very many batches."""
    several, one = ([_from_six(raw) for raw in table[name].to_pylist()] for name in ("several", "one"))
    numbers = table["batch"].to_numpy()
    sizes = [len(a) + len(b) for a, b in zip(several, one)]
    key = np.concatenate([part for pair in zip(several, one) for part in pair])
    sure = np.concatenate([np.full(len(part), flag) for pair in zip(several, one) for part, flag in zip(pair, (True, False))])
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    count = np.diff(np.append(first, len(key)))
    shared = np.repeat((count > 1) | np.logical_or.reduceat(sure[order], first), count)
    many = np.repeat(count >= hot, count)
    order, many = order[shared], many[shared]
    by_row = np.argsort(row[order], kind="stable")
    order, many = order[by_row], many[by_row]
    cuts = np.searchsorted(row[order], np.arange(len(sizes) + 1))
    spans = [(n, a, b) for n, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
    return pa.table(
        {
            "batch": longs([int(numbers[n]) for n, _, _ in spans]),
            "usual": _binaries([_six(key[order[a:b]][~many[a:b]]) for _, a, b in spans]),
            "hot": _binaries([_six(key[order[a:b]][many[a:b]]) for _, a, b in spans]),
        }
    )


# --- strings of shared anchors -----------------------------------------------------------------------------------


def _member(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)
    return sorted_set[at] == keys


class _Strings:
    """Distinct strings by number, with the key and the smallest id of each. Equal strings have equal keys."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.keys, self.least = array("q"), array("q")

    def add(self, key: int, string: bytes, doc_id: int) -> int:
        n = self.number.setdefault(string, len(self.least))
        if n == len(self.least):
            self.keys.append(key)
            self.least.append(doc_id)
        elif doc_id < self.least[n]:
            self.least[n] = doc_id
        return n


def _numbers(values: array) -> np.ndarray:
    return np.frombuffer(values, np.int64) if len(values) else np.zeros(0, np.int64)


def _places(batch: Batch, answers: list, length: int, anchor: int) -> tuple[_Strings, np.ndarray, np.ndarray]:
    """A batch's distinct strings, and the number and position of each place.

    The numbers follow from the batch and the set of its shared anchors, so a second run gives the same."""
    start, count, key, doc = runs(batch, length, anchor)
    usual, hot = (np.sort(np.concatenate([_from_six(a[name]) for a in answers])) for name in ("usual", "hot"))
    text, ids = batch.text, batch.ids
    found, names, positions = _Strings(), array("q"), array("q")

    def place(key: int, string: bytes, position: int, doc_id: int) -> None:
        names.append(found.add(key, string, doc_id))
        positions.append(position)

    # In parts: a run's numbers as Python's take several times the room of its text.
    kept = np.flatnonzero(_member(key, usual))
    for part in (kept[n : n + _PART] for n in range(0, len(kept), _PART)):
        for k, s, c, i in zip(key[part].tolist(), start[part].tolist(), count[part].tolist(), ids[doc[part]].tolist()):
            place(k, text[s : s + c + length - 1], s, i)
    kept = np.flatnonzero(_member(key, hot))
    for part in (kept[n : n + _PART] for n in range(0, len(kept), _PART)):
        for s, c, i in zip(start[part].tolist(), count[part].tolist(), ids[doc[part]].tolist()):
            for at in range(s, s + c):
                string = text[at : at + length]
                place(xxhash.xxh64_intdigest(string) >> (64 - _KEY_BITS), string, at, i)

    return found, _numbers(names), _numbers(positions)


def _strings_of(packed: bytes, answers: list, buckets: int, length: int, anchor: int) -> Iterator[tuple[int, bytes]]:
    """A batch's distinct strings, packed by bucket."""
    found, _, _ = _places(Batch(packed), answers, length, anchor)
    strings, keys, least = list(found.number), _numbers(found.keys), _numbers(found.least)
    bucket = keys % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
    for part in (order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a):
        held = [strings[n] for n in part.tolist()]
        sizes = np.array([len(string) for string in held], "<i4")
        yield int(bucket[part[0]]), _zip(keys[part].astype("<u8"), sizes, part.astype("<i4"), least[part], b"".join(held))


# --- Burrows-Wheeler transforms ------------------------------------------------------------------------------------


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `values` (bytes, 0 as terminator) in order, by doubling from seven symbols on."""
    n = len(values)
    padded = np.append(values.astype(np.int64) + 1, np.zeros(7, np.int64))  # the end comes before every symbol
    key = padded[:n].copy()
    for k in range(1, 7):
        key = key << 9 | padded[k : n + k]
    order, reach = np.argsort(key), 7
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:] + 1
        key = rank * (n + 1) + after
        order, reach = np.argsort(key), 2 * reach


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of strings that end in terminators, and the place of each row's suffix in them."""
    # UTF-8 has no byte 0xFF, so that all bytes move up by one and 0 is free.
    values = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    order = suffix_order(values)
    return values[order - 1], order


def merge(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all transforms in the order of their suffixes' first `length` symbols, and whether each begins an interval
    of suffixes that share them. Terminators are all different.

    Pass h deals the rows of intervals that pass h - 1 has split, by the symbol before them: only what stands before such a row
    can still part. All other intervals are final or wait for a split, and keep their places.
    """
    symbols = np.concatenate([bwt for bwt, _ in shards])
    n = len(symbols)
    firsts, link, base = [], np.empty(n, np.int32), 0  # link: from a row to that of the suffix one symbol longer
    for bwt, _ in shards:
        link[base + np.argsort(bwt, kind="stable")] = np.arange(base, base + len(bwt), dtype=np.int32)
        firsts.append(np.sort(bwt))
        base += len(bwt)
    # A shard's rows are sorted, and so are its symbols taken as first ones.
    first = np.concatenate(firsts)
    row = np.argsort(first, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[row] = np.arange(n, dtype=np.int32)
    first = first[row]
    new = np.append(True, (first[1:] != first[:-1]) | (first[1:] == 0))
    at, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)  # places of split intervals, and their numbers before the split
    for _ in range(length - 1):
        sources = row[at]
        before, part = symbols[sources], np.cumsum(new[at], dtype=np.int32)
        dealt = np.argsort(before, kind="stable")[np.count_nonzero(before == 0) :]
        if not len(dealt):
            break
        symbol, block, part, image = before[dealt], block[dealt], part[dealt], link[sources[dealt]]
        # All rows with one symbol before one interval are a whole interval; its places stay, the order in it is new.
        edge = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        starts = np.flatnonzero(edge).astype(np.int32)
        sizes = np.diff(np.append(starts, len(dealt)))
        to = np.repeat(np.minimum.reduceat(place[image], starts) - starts, sizes) + np.arange(len(dealt), dtype=np.int32)
        mark = np.append(False, part[1:] != part[:-1]) & ~edge
        row[to], place[image] = image, to
        new[to[mark]] = True
        split = np.repeat(np.logical_or.reduceat(mark, starts), sizes)
        at, block = to[split], np.repeat(np.arange(len(starts), dtype=np.int32), sizes)[split]
        if not len(at):
            break
    return row, new


def window_minima(strings: list[bytes], ids: np.ndarray, length: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each window of each string, the smallest id among the strings (by `ids`) that hold the same window."""
    shards = max(1, min(shards, len(strings)))
    parts = [list(range(n, len(strings), shards)) for n in range(shards)]
    made, owner, offset = [], [], []
    for part in parts:
        bwt, order = transform([strings[n] for n in part])
        sizes = np.array([len(strings[n]) + 1 for n in part])
        begin = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(part)), sizes)[order]
        owner.append(np.array(part)[which])
        offset.append(order - begin[which])
        made.append((bwt, order))
    row, new = merge(made, length)
    owner, offset = np.concatenate(owner)[row], np.concatenate(offset)[row]
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[owner], starts), np.diff(np.append(starts, len(row))))
    counts = np.array([len(string) - length + 1 for string in strings])
    base = np.cumsum(counts) - counts
    found = np.empty(int(counts.sum()), np.int64)
    whole = offset < counts[owner]
    found[base[owner[whole]] + offset[whole]] = least[whole]
    return np.split(found, base[1:])


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """To each batch, the smallest id of every window of its strings in this bucket."""
    found = _Strings()
    asked: list[tuple[int, np.ndarray, np.ndarray]] = []
    for batch, raw in zip(table["batch"].to_pylist(), table["strings"]):
        keys, sizes, numbers, doc_ids, text = _unzip(raw.as_py(), "<u8", "<i4", "<i4", "<i8", None)
        at, mine = 0, array("q")
        for key, size, doc_id in zip(keys.tolist(), sizes.tolist(), doc_ids.tolist()):
            mine.append(found.add(key, text[at : at + size], doc_id))
            at += size
        asked.append((batch, _numbers(mine), numbers))
    strings, keys, ids = list(found.number), _numbers(found.keys), _numbers(found.least)
    windows = np.fromiter((len(string) - length + 1 for string in strings), np.int64, len(strings))
    order = np.argsort(keys, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)), len(order))
    several = np.diff(cuts) > 1
    # Runs of windows with one smallest id: string, number of windows, and the id. A lone string has one run.
    lone = order[cuts[:-1][~several]]
    made = [(lone, windows[lone], ids[lone])]

    def flush(names: list[int]) -> None:
        minima = window_minima([strings[n] for n in names], ids[names], length)
        firsts = [np.flatnonzero(np.append(True, m[1:] != m[:-1])) for m in minima]
        counts = np.concatenate([np.diff(np.append(first, len(m))) for first, m in zip(firsts, minima)])
        made.append((np.repeat(names, [len(first) for first in firsts]), counts, np.concatenate([m[first] for first, m in zip(firsts, minima)])))

    held: list[int] = []
    size = 0
    for a, b in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist()):
        names = order[a:b].tolist()
        held += names
        size += sum(len(strings[n]) + 1 for n in names)
        if size >= COLLECTION:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    owner, count, least = (np.concatenate(parts) for parts in zip(*made))
    by_owner = np.argsort(owner, kind="stable")
    count, least = count[by_owner].astype("<i4"), least[by_owner].astype("<i8")
    times = np.bincount(owner, minlength=len(strings))
    begin = np.cumsum(times) - times
    answers = []
    for _, mine, numbers in asked:
        each = times[mine]
        at = np.repeat(begin[mine] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        answers.append(_zip(np.repeat(numbers, each), count[at], least[at]))
    return pa.table({"batch": longs([batch for batch, _, _ in asked]), "answer": _binaries(answers)})


# --- removal -----------------------------------------------------------------------------------------------------


def _removed(batch: Batch, name: np.ndarray, position: np.ndarray, answers: list[bytes], length: int) -> np.ndarray:
    """Which bytes of the batch go."""
    n = len(batch.values)
    change = np.zeros(n + 1, np.int32)
    if answers:
        owner, count, least = (np.concatenate(parts) for parts in zip(*[_unzip(raw, "<i4", "<i4", "<i8") for raw in answers]))
        order = np.argsort(owner, kind="stable")
        owner, count, least = owner[order], count[order].astype(np.int64), least[order]
        before = np.cumsum(count) - count
        first, end = np.searchsorted(owner, name), np.searchsorted(owner, name, side="right")
        times = end - first
        which = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        start = np.repeat(position, times) + before[which] - np.repeat(before[np.minimum(first, len(before) - 1)], times)
        doc = np.searchsorted(batch.ends, start, side="right")
        go = least[which] < batch.ids[doc]
        np.add.at(change, start[go], 1)
        np.add.at(change, start[go] + count[which][go] + length - 1, -1)
    return np.cumsum(change, out=change)[:n] > 0


def _finish(rows: Iterator[pa.RecordBatch], length: int, anchor: int, with_text: bool, with_rows: bool) -> Iterator[pa.RecordBatch]:
    for part in rows:
        carried = part.column("rows").to_pylist() if with_rows else [None] * part.num_rows
        for packed, shared, answers, raw in zip(*(part.column(name).to_pylist() for name in ("packed", "shared", "answers")), carried):
            batch = Batch(packed)
            _, name, position = _places(batch, shared, length, anchor) if answers else (None,) * 3
            removed = _removed(batch, name, position, answers or [], length)
            gone, spans, digests, kept_texts = [], [], [], []
            for start, end, null in zip(batch.starts.tolist(), batch.ends.tolist(), batch.nulls.tolist()):
                mask = removed[start:end]
                kept = batch.values[start:end][~mask].tobytes()
                gone.append(end - start - len(kept))
                spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[:1].sum()) if gone[-1] else 0)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(None if null & 2 else kept.decode("utf-8", "ignore"))
            ids = pa.array(batch.ids, pa.int64(), mask=(batch.nulls & 1).astype(bool))
            columns = [ids, longs(batch.lengths), longs(gone), longs(spans), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            if with_rows:
                held = pa.ipc.open_stream(_unzip(raw, None)[0]).read_all().combine_chunks()
                columns, names = [*columns, held.column("row").chunk(0)], [*names, "row"]
            yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False, with_rows: bool = False,
    batch_bytes: int = BATCH, bucket_bytes: int = BUCKET, hot: int = HOT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row.

    `with_text` adds kept_text, null where the text is; `with_rows` adds `row`, a struct of the row's columns but its text.
    """
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    packed = materialize_in_buckets(batches_of(documents, batch_bytes, with_rows), "dedup-batches", "batch", buckets)

    def shared(table: pa.Table) -> pa.Table:
        return _shared_anchors(table, hot)

    def resolve(table: pa.Table) -> pa.Table:
        return _resolve(table, length)

    def strings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for number, raw, answers in zip(*(part.column(name) for name in ("batch", "packed", "shared"))):
                sent = list(_strings_of(raw.as_py(), answers.as_py(), buckets, length, anchor))
                yield pa.RecordBatch.from_arrays([longs([number.as_py()] * len(sent)), longs([k for k, _ in sent]), _binaries([x for _, x in sent])], ["batch", "bucket", "strings"])

    anchors = packed.select("batch", "packed").mapInArrow(
        lambda rows: _send_anchors(rows, buckets, length, anchor), "bucket long, batch long, several binary, one binary"
    )
    answered = anchors.groupBy("bucket").applyInArrow(shared, "batch long, usual binary, hot binary")
    asked = answered.groupBy("batch").agg(F.collect_list(F.struct("usual", "hot")).alias("shared"))  # of one batch
    asked = materialize(asked, "dedup-shared")
    sent = packed.join(asked, "batch").select("batch", "packed", "shared").mapInArrow(strings, "batch long, bucket long, strings binary")
    replies = sent.groupBy("bucket").applyInArrow(resolve, "batch long, answer binary")
    marks = replies.groupBy("batch").agg(F.collect_list("answer").alias("answers"))
    carried = ["rows"] * with_rows
    # The answers are the smaller side: hashed, so that the batches need no sort.
    joined = packed.join(asked, "batch", "left").join(marks.hint("shuffle_hash"), "batch", "left").select("packed", "shared", "answers", *carried)
    schema = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    if with_rows:
        schema = schema.add("row", StructType([field for field in documents.schema.fields if field.name != "text"]))
    return joined.mapInArrow(lambda rows: _finish(rows, length, anchor, with_text, with_rows), schema)
