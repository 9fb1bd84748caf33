"""Exact top-k search by inner product, with pivot tables and elimination by lower bounds of distances.

Vectors become whole numbers, floor(scale * x). Each vector carries its distances to a fixed number of pivots (the pivot
table). For a query q and a vector x, the largest |d(q, p) - d(x, p)| over pivots p is a lower bound of d(q, x), and
<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns it into an upper bound of the score.

Vectors are ordered by nearest pivot and cut into blocks of bounded size, which keep the pivot table of their rows; a query is
one of the rows of its home block, where it is answered first, so that its k-th score there, with its id, is a floor for the
final one. Then it meets every other block. The block's range of distances to each pivot bounds all of its rows: where that
bound is below the floors of all queries of a pack, the block's vectors are not even unpacked. Else a query takes the
candidates in the order of their own bounds and stops at the first one below its k-th score so far. Bounds are rounded up by a
margin and equal ones are evaluated; a score equal to the floor counts where its id is smaller. So nothing that could win is
left out: the result is exact.

The queries are a stated set, compared in blocks with all vectors. Neither side is gathered or broadcast: a block, or the
queries of a block, is one packed row; rows and columns of the block matrix are grouped, and a task holds one cell.

Defined results: vectors that are null, hold a null or non-finite component, or lack an id take no part. A shorter vector
counts as padded with zeros. A query id on several rows gives the results of each row; no row of its own id is a candidate.
Ties go to the smaller id. Components and scores beyond 64 bits stop at the ends of a long. No rows give no rows. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import longs
from pactlens.session import materialize

BLOCKS, PACKS = 8, 32  # a task compares about so many blocks with so many packs of queries
FOUND = "query_row long, query_id long, vec_id long, score long"
_BLOCK = "block long, ids binary, vecs binary, squares binary, dist binary"
_PACK = "pack long, rows binary, query_ids binary, query_vecs binary, query_squares binary, query_dist binary, floors binary, floor_ids binary"
NO_FLOOR = 2**63 - 1  # every id counts at such a floor


def whole_numbers(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """vec_id and v, the components as longs, of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & finite & F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


def choose_pivots(vectors: DataFrame, pivots: int, sample: int, width: int) -> np.ndarray:
    """Pivots far from each other, out of the `sample` vectors with the lowest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    table = padded([row.v for row in rows], width).astype(np.float64)
    if not len(table):
        return np.zeros((0, width))
    chosen = [table[np.argmax(distances(table, table.mean(axis=0, keepdims=True))[:, 0])]]
    nearest = distances(table, chosen[0][None])[:, 0]
    while len(chosen) < pivots and nearest.max() > 0:
        chosen.append(table[np.argmax(nearest)])
        nearest = np.minimum(nearest, distances(table, chosen[-1][None])[:, 0])
    return np.array(chosen)


def padded(rows: list, width: int) -> np.ndarray:
    table = np.zeros((len(rows), width), np.int64)
    for n, row in enumerate(rows):
        table[n, : len(row)] = row
    return table


def distances(table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows by pivots, from the differences themselves, so that small distances keep their digits."""
    return np.stack([np.sqrt(((table - pivot) ** 2).sum(axis=1)) for pivot in pivots], axis=1) if len(pivots) else np.zeros((len(table), 0))


def score_bounds(square: float, dist: np.ndarray, squares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Upper bounds of one query's scores: its square norm and pivot distances against those of all candidates."""
    gap = np.abs(table - dist).max(axis=1, initial=0)
    gap = np.maximum(gap * (1 - 1e-9) - 1e-9 * (dist.max(initial=0) + table.max(axis=1, initial=0)), 0)
    return (square + squares - gap * gap) / 2 + 1e-9 * (square + squares) + 1e-9


def block_bounds(q_squares: np.ndarray, q_dist: np.ndarray, squares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's scores with any row of a block, from the block's range of distances to each pivot."""
    if not len(table):
        return np.full(len(q_squares), -np.inf)
    low, high = table.min(axis=0, initial=np.inf), table.max(axis=0, initial=0)
    gap = np.maximum(low - q_dist, q_dist - high).max(axis=1, initial=0)
    gap = np.maximum(gap * (1 - 1e-9) - 1e-9 * (q_dist.max(axis=1, initial=0) + high.max(initial=0)), 0)
    most = squares.max()
    return (q_squares + most - gap * gap) / 2 + 1e-9 * (q_squares + most) + 1e-9


def best_of_block(query, own_id, floor, floor_id, bounds, ids, values, k):
    """Ids and scores of the k best rows above a floor (score, id), best first, taken in the order of their bounds."""
    candidates = np.flatnonzero((bounds >= floor) & (ids != own_id))
    candidates = candidates[np.argsort(-bounds[candidates])]
    best_ids, best, at, step = ids[:0], values[:0, 0] if values.shape[1] else np.zeros(0), 0, 2 * k
    while at < len(candidates) and bounds[candidates[at]] >= floor:
        chunk = candidates[at : at + step]
        scores = values[chunk] @ query
        kept = (scores > floor) | ((scores == floor) & (ids[chunk] < floor_id))
        best_ids, best = np.concatenate([best_ids, ids[chunk[kept]]]), np.concatenate([best, scores[kept]])
        if len(best) >= k:
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            floor, floor_id = higher(floor, floor_id, best, best_ids)
        at, step = at + step, 2 * step
    return best_ids, best


def higher(floor, floor_id, best, best_ids) -> tuple[float, int]:
    """The floor, or the last of k best rows where that is higher."""
    last = _below(best[-1])
    last_id = int(best_ids[-1]) if last == best[-1] else NO_FLOOR
    return (last, last_id) if last > floor or (last == floor and last_id < floor_id) else (floor, floor_id)


class Measure:
    """How vectors are kept and multiplied, and their pivot table."""

    def __init__(self, width: int, most: int, pivots: np.ndarray):
        self.width, self.pivots = width, pivots
        self.stored = next(kind for kind in (np.int16, np.int32, np.int64) if most <= np.iinfo(kind).max)
        largest = most * most * max(width, 1)
        self.kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**63 else object

    def pack(self, values: np.ndarray) -> bytes:
        return values.astype(self.stored).tobytes()

    def unpack(self, raw: bytes, rows: int) -> np.ndarray:
        values = np.frombuffer(raw, self.stored).reshape(rows, self.width)
        return values.astype(np.int64).astype(self.kind) if self.kind is object else values.astype(self.kind)

    def shape(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = values.astype(np.float64)
        return (plain * plain).sum(axis=1), distances(plain, self.pivots)


def _below(score) -> float:
    """A double that is not above an exact score."""
    return float(score) if abs(score) < 2**53 else float(score) * (1 - 1e-9 if score > 0 else 1 + 1e-9)


def _as_long(scores) -> np.ndarray:
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores], np.int64)


def _found(rows, query_ids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(rows), longs(query_ids), longs(ids), longs(_as_long(scores))], ["query_row", "query_id", "vec_id", "score"])


def _search(k: int, asked: dict, block: dict, values) -> Iterator[tuple]:
    """(position, ids, scores, best first) of each query with results in this block; `values` unpacks the block's vectors."""
    met = np.flatnonzero(block_bounds(asked["squares"], asked["dist"], block["squares"], block["dist"]) >= asked["floors"])
    if not len(met):
        return
    vectors = values()
    for n in met.tolist():
        bounds = score_bounds(asked["squares"][n], asked["dist"][n], block["squares"], block["dist"])
        if len(bounds) and bounds.max() >= asked["floors"][n]:
            yield n, *best_of_block(asked["vectors"][n], asked["ids"][n], asked["floors"][n], asked["floor_ids"][n], bounds, block["ids"], vectors, k)


def _tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of `size` rows, in their order."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == size:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _home(batches, measure: Measure, k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks, each with its own queries answered inside it and the floors they got."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for part in _tables(batches, size):
        values = measure.unpack(measure.pack(padded(part["v"].to_pylist(), measure.width)), part.num_rows)
        ids = part["vec_id"].to_numpy()
        squares, dist = measure.shape(values)
        own = np.flatnonzero(part["asked"].to_numpy(zero_copy_only=False))
        rows = number * 4096 + own
        asked = {"ids": ids[own], "vectors": values[own], "squares": squares[own], "dist": dist[own]}
        asked |= {"floors": np.full(len(own), -np.inf), "floor_ids": np.full(len(own), NO_FLOOR)}
        block = {"ids": ids, "squares": squares, "dist": dist}
        answers = [(rows[:0], ids[:0], ids[:0], [])]
        for n, got, scores in _search(k, asked, block, lambda held=values: held):
            answers.append((np.full(len(got), rows[n]), np.full(len(got), ids[own[n]]), got, scores))
            if len(got) == k:
                asked["floors"][n], asked["floor_ids"][n] = higher(-np.inf, NO_FLOOR, scores, got)
        found = _found(*(np.concatenate([a[c] for a in answers]) for c in range(4)))
        home = pa.array([found.to_struct_array().to_pylist()], pa.list_(found.to_struct_array().type))
        binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes() if isinstance(x, np.ndarray) else x], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                longs([number]), binary(ids), binary(measure.pack(values)), binary(squares), binary(dist), longs([number]), binary(rows), binary(ids[own]),
                binary(measure.pack(values[own])), binary(squares[own]), binary(dist[own]), binary(asked["floors"]), binary(asked["floor_ids"]), home,
            ],
            [*(name.split()[0] for name in f"{_BLOCK}, {_PACK}".split(", ")), "home"],
        )
        number += 1


def _away(left: pa.Table, right: pa.Table, measure: Measure, k: int) -> pa.Table:
    """One cell of the matrix: its packs of queries against its blocks, and the k best of the cell for each query."""
    whole = lambda raw, kind=np.float64: np.frombuffer(raw, kind)
    blocks = []
    for b in left.to_pylist():
        ids = whole(b["ids"], np.int64)
        blocks.append((b["block"], b["vecs"], {"ids": ids, "squares": whole(b["squares"]), "dist": whole(b["dist"]).reshape(len(ids), -1)}))
    answers = [(np.zeros(0, np.int64),) * 3 + ([],)]
    for pack in right.to_pylist():
        rows, query_ids = whole(pack["rows"], np.int64), whole(pack["query_ids"], np.int64)
        asked = {"ids": query_ids, "vectors": measure.unpack(pack["query_vecs"], len(rows)), "squares": whole(pack["query_squares"])}
        asked |= {"dist": whole(pack["query_dist"]).reshape(len(rows), -1), "floors": whole(pack["floors"]).copy(), "floor_ids": whole(pack["floor_ids"], np.int64).copy()}
        best: dict[int, tuple] = {}
        for number, vecs, block in blocks:
            if number == pack["pack"]:
                continue  # answered at home
            for n, got, scores in _search(k, asked, block, partial(measure.unpack, vecs, len(block["ids"]))):
                if n in best:
                    got, scores = np.concatenate([best[n][0], got]), np.concatenate([best[n][1], scores])
                    top = np.lexsort((got, -scores))[:k]
                    got, scores = got[top], scores[top]
                best[n] = got, scores
                if len(got) == k:
                    asked["floors"][n], asked["floor_ids"][n] = higher(asked["floors"][n], asked["floor_ids"][n], scores, got)
        answers += [(np.full(len(got), rows[n]), np.full(len(got), query_ids[n]), got, scores) for n, (got, scores) in best.items()]
    return pa.Table.from_batches([_found(*(np.concatenate([a[c] for a in answers]) for c in range(4)))])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", row_id: str = "vec_id", scale: int = 64,
    pivots: int = 16, pivot_sample: int = 2000, block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row that meets `is_query`, a condition on vec_id.

    `pivot_sample` bounds the vectors that pivots are chosen from; every vector is indexed. `block` (at most 4096) bounds the
    rows of a block.
    """
    numbers = materialize(whole_numbers(vectors, vector, row_id, scale).withColumn("asked", F.coalesce(is_query, F.lit(False))), "topk-vectors")
    low, high = F.array_min("v"), F.array_max("v")
    shape = numbers.agg(F.max(F.size("v")).alias("width"), F.min(low).alias("low"), F.max(high).alias("high")).first()
    most = max(-(shape.low or 0), shape.high or 0)
    measure = Measure(shape.width or 0, min(most, 2**63 - 1), choose_pivots(numbers, pivots, pivot_sample, shape.width or 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, dist = measure.shape(padded(batch.column("v").to_pylist(), measure.width))
            near = dist.argmin(axis=1) if dist.shape[1] else np.zeros(batch.num_rows)
            gap = dist.min(axis=1) if dist.shape[1] else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap.astype(float))], [*batch.schema.names, "near", "gap"])

    ordered = numbers.mapInArrow(placed, "vec_id long, v array<long>, asked boolean, near int, gap double")
    ordered = ordered.repartitionByRange("near", "gap", "vec_id").sortWithinPartitions("near", "gap", "vec_id").select("vec_id", "v", "asked")
    schema = f"{_BLOCK}, {_PACK}, home array<struct<query_row: long, query_id: long, vec_id: long, score: long>>"
    homes = materialize(ordered.mapInArrow(partial(_home, measure=measure, k=k, size=min(block, 4096)), schema), "topk-blocks")
    at_home = homes.select(F.explode("home").alias("h")).select("h.*")

    count = homes.count()
    wide, high = -(-count // PACKS), -(-count // BLOCKS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(max(n, 1))).cast("int")
    blocks = homes.select("block", "ids", "vecs", "squares", "dist", group(high).alias("row"), every(wide).alias("col"))
    asking = homes.where(F.length("rows") > 0)
    packs = asking.select(*[name.split()[0] for name in _PACK.split(", ")], every(high).alias("row"), group(wide).alias("col"))
    away = blocks.groupBy("row", "col").cogroup(packs.groupBy("row", "col")).applyInArrow(partial(_away, measure=measure, k=k), FOUND)

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = at_home.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
