"""Best-fit packing of tokenized documents into training sequences by the sum-of-squares rule.

A document longer than a sequence is cut into full pieces and a shorter rest; no other document is cut. Full pieces are
sequences of their own. Every other piece goes where the sum over all gaps g of N(g)^2 becomes smallest, N(g) being the
number of open sequences with g tokens left; a new sequence competes on the same terms, and equal changes go to the smallest
gap. Pieces come longest first.

Pieces are dealt at random over shards of a bounded number of pieces, each packed by one task. What lies in sequences that
did not become full is pooled over all shards and packed again in fewer shards of the same size, so that the loss does not
grow with their number. A round that fills under an eighth of its pieces is the last one, as lengths that do not combine in one shard do
not combine in another; the sequences of its shards are final. Work and memory of a task stay bounded; only lengths are
shuffled, no text.

Defined results: a null text is an empty document, which is its end id alone. Repeated rows, or rows without a doc_id, are
documents of their own. An empty table gives no sequences. A very long text is encoded whole by one task and cut there. Other
columns of documents are ignored; columns of pieces are carried through `pack`, but for `sequence_id` and `offset`, which
its results replace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import ids_and_text, longs, texts
from pactlens.llm.word_tokens import encoder
from pactlens.session import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
SHARD_PIECES = 16_384
_SHARD_BITS, _PLACE_BITS = 29, 24  # of a sequence id; ten bits are left for the round


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids, its end id included; `with_ids` adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode_all(texts(batch))):
                ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, n, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            doc_ids, numbers, starts, lengths, crcs, parts = zip(*rows) if rows else [()] * 6
            columns = [longs(doc_ids), pa.array(numbers, pa.int32()), longs(starts), longs(lengths), longs(crcs)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ids_and_text(documents).mapInArrow(cut, PIECE + ", ids array<long>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the order given, and the gap left in each sequence."""
    count = np.zeros(capacity + 1)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for n, size in enumerate(lengths.tolist()):
        here, left = count[size:], count[: capacity - size + 1]
        change = np.where(here > 0, 2 * (left - here) + 2, np.inf)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]  # filled: no gap comes in its place
        best = int(change.argmin())
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = size + best
            sequence = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = capacity, len(gaps)
            gaps.append(capacity)
        place[n], offset[n] = sequence, capacity - gap
        gaps[sequence] = gap = gap - size
        if gap:
            open_by_gap[gap].append(sequence)
            count[gap] += 1
    return place, offset, np.array(gaps, np.int64)


def sequence_ids(round_number: int, shard: int, place: np.ndarray) -> np.ndarray:
    """Round, shard and place in fields of one long each number fits."""
    if round_number >> 63 - _SHARD_BITS - _PLACE_BITS or shard >> _SHARD_BITS or (len(place) and int(place.max()) >> _PLACE_BITS):
        raise ValueError(f"round {round_number}, shard {shard} or a place in it is beyond the fields of a sequence id")
    return (((round_number << _SHARD_BITS) + shard) << _PLACE_BITS) + place.astype(np.int64)


def _pack_shard(shard: pa.Table, capacity: int, round_number: int) -> pa.Table:
    length = shard["length"].to_numpy()
    order = np.lexsort((shard["row"].to_numpy(), -length))
    shard = shard.take(pa.array(order))
    place, offset, gaps = sum_of_squares(length[order], capacity)
    number = int(shard["shard"][0].as_py())
    sequence = sequence_ids(round_number, number, place)
    return (
        shard.drop_columns(["shard", "sequence_id", "offset", "gap"])
        .append_column("sequence_id", longs(sequence))
        .append_column("offset", longs(offset))
        .append_column("gap", longs(gaps[place]))
    )


def _shard_packer(capacity: int, round_number: int):
    def pack_shard(shard: pa.Table) -> pa.Table:
        return _pack_shard(shard, capacity, round_number)

    return pack_shard


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """`pieces` (with a column length, 1 to `capacity`) with sequence_id and offset added."""
    taken = [name for name in pieces.columns if name.lower() in ("row", "shard", "gap", "sequence_id", "offset")]
    if taken:  # set aside while the work uses these names
        aside = {name: f"carried_{n}_{name}" for n, name in enumerate(taken)}
        back = {new: name for name, new in aside.items() if name.lower() not in ("sequence_id", "offset")}
        packed = pack(pieces.withColumnsRenamed(aside), capacity, shard_pieces).drop(*[new for new in aside.values() if new not in back])
        return packed.withColumnsRenamed(back)
    names = pieces.columns
    held = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # A full piece is a sequence by itself; its number is below zero.
    done = [held.where(F.col("length") >= capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = held.where(F.col("length") < capacity).withColumns({name: F.lit(0).cast("long") for name in ("sequence_id", "offset", "gap")})
    kept = [*names, "row", "sequence_id", "offset", "gap"]
    schema = rest.select(kept).schema
    round_number, count = 0, rest.count()
    while True:
        shards = max(1, -(-count // shard_pieces))
        # The round takes part in the deal: the same pieces would meet again otherwise.
        dealt = rest.select(*kept, F.pmod(F.xxhash64("row", F.lit(round_number)), F.lit(shards)).alias("shard"))
        packed = materialize(dealt.groupBy("shard").applyInArrow(_shard_packer(capacity, round_number), schema), "packed")
        rest = packed.where(F.col("gap") > 0)
        before, count = count, rest.count()
        if shards == 1 or count > before - before / 8:
            done.append(packed.select(*names, "sequence_id", "offset"))
            break
        done.append(packed.where(F.col("gap") == 0).select(*names, "sequence_id", "offset"))
        round_number += 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces that carry `ids`."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
