"""Packing where lengths do not combine, and numbers of many rounds."""

import math

import numpy as np
from pyspark.sql import functions as F

from pactlens.llm import packing


def test_no_task_grows_with_the_pool(spark, make_documents):
    make_documents([])
    draw = np.random.default_rng(3)
    lengths = [1100 if n % 3 == 0 else int(draw.integers(20, 2000)) for n in range(6000)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    packed = packing.pack(frame, 2048, shard_pieces=256).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(lengths))
    shards, bins = {}, {}
    for r in packed:
        shards.setdefault(r.sequence_id >> packing._PLACE_BITS, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert max(map(len, shards.values())) <= 256 * 1.5
    for held in bins.values():
        assert [offset for offset, _ in sorted(held)] == [sum(size for _, size in sorted(held)[:n]) for n in range(len(held))]
        assert sum(size for _, size in held) <= 2048
    _, _, whole = packing.sum_of_squares(np.array(sorted(lengths, reverse=True)), 2048)
    assert len(bins) <= 1.02 * len(whole)
    assert len(bins) >= math.ceil(sum(lengths) / 2048)


def test_sequence_ids_of_late_rounds():
    seen = [packing.sequence_ids(r, s, np.array([0, 1, (1 << 24) - 1])) for r in (0, 7, 8, 200, 1023) for s in (0, 1, (1 << 29) - 1)]
    flat = np.concatenate(seen)
    assert len(set(flat.tolist())) == len(flat) and flat.min() >= 0 and (np.diff(flat) > 0).all()


def test_clashing_columns_of_pieces(spark, make_documents):
    make_documents([])
    frame = spark.range(300).select((F.col("id") % 90 + 1).alias("length"), F.col("id").alias("row"), F.lit("s").alias("shard"), F.lit(9).alias("gap"), F.lit(1).alias("Offset"), F.lit(2).alias("sequence_id"))
    packed = packing.pack(frame, 128, shard_pieces=50)
    assert sorted(packed.columns) == sorted(["length", "row", "shard", "gap", "sequence_id", "offset"])
    rows = packed.collect()
    assert sorted((r["row"], r.length, r.shard, r.gap) for r in rows) == [(n, n % 90 + 1, "s", 9) for n in range(300)]
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in fill.values():
        assert [o for o, _ in sorted(held)] == [sum(x for _, x in sorted(held)[:n]) for n in range(len(held))]
