"""SimHash near-duplicates: fingerprints linked at a few differing bits, through a Gray-order hierarchical index.

Fingerprint: A-Z lower-cased, words cut at ASCII white space, shingles of four words; a bit is set when it is set in
over half of the shingles' XXH64 values (seed 42). A text without words has fingerprint zero and is linked like any other.

Index. Equal fingerprints form one class first, so copies cost one row. A fingerprint of 64 bits is cut into blocks; two
that differ in at most d bits agree on all bits of at least (blocks - d) blocks. For each choice of that many blocks the
chosen bits move to the front of the code, and the codes are sorted by Gray rank, which puts codes of few differences
side by side. The chosen bits are the top node of the hierarchy: only codes below the same top node are compared, and every
close pair is below the same top node for some choice. Below it, runs of the order form leaves, and runs inside a leaf form
smaller nodes. A node stores the bits all of its members share (mask and pattern). Where two nodes' shared bits differ, so do
all of their members: pairs of leaves with more than d such bits are left out whole, then pairs of nodes inside the others.

Spark's range partitions hold the order. A top node that spans several leaves (a hot one, or one across a partition's edge)
gives pairs of leaves, pruned by their patterns, and each surviving pair is compared by a task of its own: no group is
gathered as a whole, none is capped, and each leaf is of bounded size. A comparison emits the links of a spanning forest
rather than all pairs: what is reachable stays the same. Components come from star contraction with a written table per round.

Defined results: null texts count as empty. A null doc_id keeps its row and never names a component unless all members
lack one. Repeated rows stay repeated. A very long text's shingles are hashed in steps by one task, which holds its words.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import ids_and_text, longs, texts
from pactlens.session import materialize

BITS = 64
LEAF = 512  # codes of a leaf
NODE = 32  # codes of a node inside a leaf
ROWS_PER_TOP = 64  # the number of blocks grows until a top node holds about so many codes
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """Fingerprint of one text; shingles are hashed in steps, so memory does not grow with their number."""
    words = text.lower().split()  # bytes: lowers A-Z and cuts at ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([tuple(words)])
    else:
        shingles = zip(*(islice(words, n, None) for n in range(width)))
    ones, count = np.zeros(BITS, np.int64), 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    while hashes := [digest(join(shingle), 42) for shingle in islice(shingles, _STEP)]:
        raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, width) for text in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), longs(found)], ["doc_id", "fp"])

    return ids_and_text(documents).mapInArrow(run, "doc_id long, fp long")


# --- index -------------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def layouts(differences: int, blocks: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of blocks that may agree: bits of the top node, and the (shift, bits) fields in their new order."""
    edges = [BITS * n // blocks for n in range(blocks + 1)]
    fields = [(edges[n], edges[n + 1] - edges[n]) for n in range(blocks)]
    found = []
    for chosen in combinations(range(blocks), blocks - differences):
        order = [fields[n] for n in chosen] + [fields[n] for n in range(blocks) if n not in chosen]
        found.append((sum(fields[n][1] for n in chosen), order))
    return found


def rearranged(codes: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(codes)
    for shift, bits in order:
        field = (codes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        out = (out << np.uint64(bits)) | field
    return out


def block_count(fingerprints: int, differences: int) -> int:
    """Blocks that keep a top node at about ROWS_PER_TOP codes; the result is the same for every number."""
    blocks = differences + 1
    while blocks < differences + 4 and fingerprints > ROWS_PER_TOP << (BITS * (blocks - differences) // blocks):
        blocks += 1
    return blocks


def _shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that each run of codes shares."""
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return ~(every ^ some), every


def close_pairs(a: np.ndarray, b: np.ndarray, differences: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of codes of a and b, both in Gray order, within `differences` bits: nodes first, then their members."""
    starts_a, starts_b = np.arange(0, len(a), NODE), np.arange(0, len(b), NODE)
    mask_a, pattern_a = _shared(a, starts_a)
    mask_b, pattern_b = _shared(b, starts_b)
    apart = (pattern_a[:, None] ^ pattern_b[None, :]) & mask_a[:, None] & mask_b[None, :]
    left, right = np.nonzero(np.bitwise_count(apart) <= differences)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    inside = np.arange(NODE)
    for n in range(0, len(left), 256):  # members of 256 pairs of nodes at a time
        rows = starts_a[left[n : n + 256], None] + inside
        cols = starts_b[right[n : n + 256], None] + inside
        near = np.bitwise_count(a[np.minimum(rows, len(a) - 1)][:, :, None] ^ b[np.minimum(cols, len(b) - 1)][:, None, :]) <= differences
        near &= (rows < len(a))[:, :, None] & (cols < len(b))[:, None, :]
        pair, i, j = np.nonzero(near)
        found.append((rows[pair, i], cols[pair, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest(names: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each member of a connected set to its smallest name, given links between positions."""
    label = np.arange(len(names))
    order = np.argsort(names, kind="stable")
    rank = np.empty_like(order)
    rank[order] = label
    label = rank.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[order[new]])
        if np.array_equal(new, label):
            break
        label = new
    root = order[label]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


_INDEX = "kind string, choice int, top long, leaf long, code long, fp long, other long"


def _rows(kind: str, choice, top, leaf, code, fp, other) -> pa.RecordBatch:
    n = len(fp)
    full = lambda x: np.broadcast_to(np.asarray(x), n)
    as_long = lambda x: longs(np.ascontiguousarray(full(x)).astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(full(choice).astype(np.int32)), *map(as_long, (top, leaf, code, fp, other))],
        ["kind", "choice", "top", "leaf", "code", "fp", "other"],
    )


def _index_partition(batches, tops: list[int], differences: int, leaf_size: int) -> Iterator[pa.RecordBatch]:
    """Sorted codes to links inside leaves, and to `open` rows of top nodes that may have more than one leaf.

    The rows of one leaf are held, no more. A leaf is open when its node has another one here, or when the node is this
    partition's first or last one and so may go on in a neighbouring partition.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size, node, first, several = 0, None, True, False

    def close(opened: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        code, rank, fp = (np.concatenate(parts) for parts in zip(*held))
        held, size = [], 0
        a, b = forest(fp, *close_pairs(code, code, differences)) if len(fp) > 1 else (fp[:0], fp[:0])
        if len(a):
            yield _rows("link", node[0], 0, 0, 0, a, b)
        if opened:
            yield _rows("open", node[0], node[1], rank[0], code, fp, 0)

    for batch in batches:
        choice = batch.column("choice").to_numpy()
        code, rank, fp = (np.asarray(batch.column(name).to_numpy()).view(np.uint64) for name in ("code", "rank", "fp"))
        top = code >> np.array([BITS - bits for bits in tops], np.uint64)[choice]
        cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(top) != 0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
            if begin == end:
                continue
            here = (int(choice[begin]), int(top[begin]))
            if here != node:
                if node is not None:
                    yield from close(first or several)
                    first = False
                node, several = here, False
            while begin < end:
                if size == leaf_size:
                    several = True
                    yield from close(True)
                upto = min(end, begin + leaf_size - size)
                held.append((code[begin:upto], rank[begin:upto], fp[begin:upto]))
                size += upto - begin
                begin = upto
    if size:
        yield from close(True)


def links(classes: DataFrame, differences: int = 4, leaf_size: int = LEAF, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between fingerprints of `classes` (column fp, distinct) whose closure is that of all close pairs."""
    spark = classes.sparkSession
    blocks = blocks or block_count(classes.count(), differences)
    plan = layouts(differences, blocks)
    tops = [bits for bits, _ in plan]

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp").to_numpy()).view(np.uint64)
            for choice, (_, order) in enumerate(plan):
                code = rearranged(fp, order)
                rank = gray_rank(code) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), choice, np.int32)), longs(rank.view(np.int64)), longs(code.view(np.int64)), longs(fp.view(np.int64))],
                    ["choice", "rank", "code", "fp"],
                )

    codes = classes.select("fp").mapInArrow(arrange, "choice int, rank long, code long, fp long")
    ordered = codes.repartitionByRange("choice", "rank").sortWithinPartitions("choice", "rank")
    index = materialize(ordered.mapInArrow(lambda batches: _index_partition(batches, tops, differences, leaf_size), _INDEX), "simhash-index")
    inside = index.where("kind = 'link'").select(F.col("fp").alias("a"), F.col("other").alias("b"))

    opened = index.where("kind = 'open'")
    leaves = opened.groupBy("choice", "top", "leaf").agg(
        F.expr("bit_and(code)").alias("every"), F.expr("bit_or(code)").alias("some")
    )
    one, two = leaves.alias("one"), leaves.alias("two")
    apart = F.expr("(one.every ^ two.every) & ~(one.every ^ one.some) & ~(two.every ^ two.some)")
    pairs = one.join(
        two,
        (F.col("one.choice") == F.col("two.choice"))
        & (F.col("one.top") == F.col("two.top"))
        & (F.col("one.leaf") < F.col("two.leaf"))
        & (F.bit_count(apart) <= differences),
    ).select("one.choice", F.col("one.leaf").alias("left"), F.col("two.leaf").alias("right"))
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("leaf")), F.struct(F.lit(1).alias("side"), F.col("right").alias("leaf")))).alias("s"))
    members = (
        sides.select("choice", "left", "right", "s.side", "s.leaf")
        .join(opened.select("choice", "leaf", "code", "fp"), ["choice", "leaf"])
        .repartition("choice", "left", "right")
        .sortWithinPartitions("choice", "left", "right", "side")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("choice", "left", "right")):
            side = rows["side"]
            code, fp = rows["code"].view(np.uint64), rows["fp"].view(np.uint64)
            order = np.lexsort((gray_rank(code), side))
            side, code, fp = side[order], code[order], fp[order]
            cut = int(np.searchsorted(side, 1))
            i, j = close_pairs(code[:cut], code[cut:], differences)
            a, b = forest(fp, i, j + cut)
            yield pa.RecordBatch.from_arrays([longs(a.view(np.int64)), longs(b.view(np.int64))], ["a", "b"])

    across = members.select("choice", "left", "right", "side", "code", "fp").mapInArrow(compare, "a long, b long")
    return inside.unionByName(across)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of rows with equal keys; a run may span batches."""
    held: dict[str, list[np.ndarray]] | None = None
    current = None
    for batch in batches:
        columns = {name: np.asarray(batch.column(name).to_numpy()) for name in batch.schema.names}
        changed = np.zeros(max(batch.num_rows - 1, 0), bool)
        for key in keys:
            changed |= columns[key][1:] != columns[key][:-1]
        cuts = np.flatnonzero(changed) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if begin == end:
                continue
            key = tuple(columns[name][begin] for name in keys)
            if key != current and held is not None:
                yield {name: np.concatenate(parts) for name, parts in held.items()}
                held = None
            current = key
            held = held or {name: [] for name in columns}
            for name, values in columns.items():
                held[name].append(values[begin:end])
    if held is not None:
        yield {name: np.concatenate(parts) for name, parts in held.items()}


# --- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); root is the smallest node reachable.

    Star contraction: each round first ties a node's larger neighbours to its smallest one, then its smaller neighbours and
    itself. Minima combine before their shuffle, and the joins' many-sides can be split, so hubs are no hot spot. The
    rounds grow with the logarithm of a component's size.
    """
    def tidy(frame: DataFrame) -> DataFrame:
        return frame.where("u <> v").distinct()

    stars = materialize(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        stars = materialize(tidy(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))), "stars")
        state = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(documents: DataFrame, differences: int = 4, width: int = 4, leaf_size: int = LEAF, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    marked = materialize(fingerprints(documents, width), "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, differences, leaf_size, blocks))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = placed.join(named, "root").select("fp", "component_id")
    return marked.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
