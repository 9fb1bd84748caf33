"""Token-id files: each document's ids compressed on its own with a dictionary that all documents share.

A shared dictionary makes short documents small although each can be read alone. It is trained on the serialized ids of a
bounded sample of documents (`dictionary_sample`, a row of each id): up to PIECES pieces of PIECE_IDS ids of each, spread evenly
over the whole document. Every file names it by its hash.

File format (all numbers little-endian), one file per shard of ascending doc_ids:

    magic  8 bytes, `PLTOKEN2`
    dictionary hash  32 bytes, SHA-256
    frames  one zstandard frame per document, of its ids as unsigned numbers of `width` bytes
    index  per document: doc_id i64, null doc_id u8 (1 if so), first id's place in the shard u64, number of ids u64, offset of
           its frame u64, length u64
    tail  offset of the index u64, number of documents u64, width u8, magic again

The dictionary itself is a file beside the shards, and a Parquet manifest lists the shards with the place of their first
id in the whole. A shard counts only once the manifest names it: a task that is run again, or twice at a time, writes a
file of its own name, and whatever the manifest does not name is ignored.

Spark range-partitions the texts by doc_id, encodes each partition in order and writes its shards; the place of a shard's
first id is a running sum over the manifest, one row per shard.

Defined results: a null text is empty and has the end id only. Rows without a doc_id come first, in no fixed order, and
repeated ids stay repeated. A very long text is encoded and compressed whole, by one task. An empty table gives an empty
manifest. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.common import ids_and_text, longs, texts
from pactlens.llm.word_tokens import encoder

MAGIC = b"PLTOKEN2"
PIECES, PIECE_IDS = 16, 512
ENTRY = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("start", "<u8"), ("n", "<u8"), ("offset", "<u8"), ("length", "<u8")])
_TAIL = struct.Struct("<QQB8s")


def _place(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, f"{path.rstrip('/')}/{name}"


def _uri(folder: str) -> str:
    """`file:/x`, as Spark may write it, with the slashes that other libraries ask for."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def train_dictionary(documents: DataFrame, tokenizer: str, width: int = 2, dictionary_sample: int = 2000, size: int = 65_536, level: int = 3) -> bytes:
    """Dictionary from the ids of `dictionary_sample` documents, those with the lowest hashes of their ids; made by one task."""
    named = ids_and_text(documents).where("doc_id IS NOT NULL")
    chosen = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(dictionary_sample)  # bounded
    found = named.join(F.broadcast(chosen), "doc_id")
    sample = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for batch in batches:
            for ids in encoder(tokenizer, width).encode_all(texts(batch)):
                parts += spread(ids, PIECE_IDS * width, PIECES)
        parts.sort()
        try:
            made = zstandard.train_dictionary(size, parts, level=level).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b"".join(parts)[-size:]  # too little to learn from: the ids themselves are the dictionary
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["dictionary"])

    row = sample.mapInArrow(train, "dictionary binary").first()
    return bytes(row.dictionary) if row else b""


def spread(ids: bytes, piece: int, most: int) -> list[bytes]:
    """Pieces of `piece` bytes from the whole of `ids`: all of them, or `most` at even distances."""
    count = -(-len(ids) // piece)
    return [ids[piece * n : piece * (n + 1)] for n in (range(count) if count <= most else (k * count // most for k in range(most)))]


class ShardWriter:
    """Writes one shard's frames as they come and its index at the end."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, level: int = 3):
        system, path = _place(_uri(folder), name)
        self._out = system.open_output_stream(path, compression=None)
        self._compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self._out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self._at, self._start, self._width, self._index = len(MAGIC) + 32, 0, width, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._compressor.compress(ids)
        count = len(ids) // self._width
        self._index.append((doc_id or 0, doc_id is None, self._start, count, self._at, len(frame)))
        self._out.write(frame)
        self._at += len(frame)
        self._start += count

    @property
    def ids(self) -> int:
        return self._start

    @property
    def documents(self) -> int:
        return len(self._index)

    def close(self) -> None:
        self._out.write(np.array(self._index, ENTRY).tobytes())
        self._out.write(_TAIL.pack(self._at, len(self._index), self._width, MAGIC))
        self._out.close()


class ShardReader:
    """Reads any document of a shard by one seek, after reading the index."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        system, path = _place(_uri(folder), name)
        self._in = system.open_input_file(path)
        head = self._in.read_at(len(MAGIC) + 32, 0)
        at, count, width, magic = _TAIL.unpack(self._in.read_at(_TAIL.size, self._in.size() - _TAIL.size))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        if head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.kind = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self._in.read_at(count * ENTRY.itemsize, at), ENTRY)
        self._decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, n: int) -> np.ndarray:
        entry = self.index[n]
        frame = self._in.read_at(int(entry["length"]), int(entry["offset"]))
        return np.frombuffer(self._decompressor.decompress(frame), self.kind)

    def close(self) -> None:
        self._in.close()


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 1, width: int = 2, shard_ids: int = 16_000_000, dictionary_sample: int = 2000) -> DataFrame:
    """Writes the shards, the dictionary and the manifest below `folder`, which all tasks must reach; returns the manifest."""
    spark = documents.sparkSession
    dictionary = train_dictionary(documents, tokenizer, width, dictionary_sample)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    reach = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards")
    reach.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(reach)
    end = np.array([end_id], f"<u{width}").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number, writer, first = TaskContext.get().partitionId(), 0, None, None

        def done() -> pa.RecordBatch:
            writer.close()
            row = [[partition * 65_536 + number], [name], [writer.documents], [writer.ids], [first]]
            return pa.RecordBatch.from_arrays([longs(row[0]), pa.array(row[1]), *map(longs, row[2:])], ["shard", "file", "documents", "ids", "first_doc"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer, width).encode_all(texts(batch))):
                if writer is None:
                    name, first = f"{partition:06d}-{number:05d}-{uuid.uuid4().hex}.tok", doc_id
                    writer = ShardWriter(f"{folder}/shards", name, dictionary, width)
                writer.add(doc_id, ids + end)
                if writer.ids >= shard_ids:
                    yield done()
                    writer, number = None, number + 1
        if writer is not None:
            yield done()

    ordered = ids_and_text(documents).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(shards, "shard long, file string, documents long, ids long, first_doc long").write.parquet(f"{folder}/listed")
    listed = spark.read.parquet(f"{folder}/listed")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard of millions of ids
    listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone; `with_ids` adds the ids."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                shard = ShardReader(f"{folder}/shards", name, dictionary)
                for begin in range(0, len(shard.index), 1024):
                    rows = shard.index[begin : begin + 1024]
                    ids = [shard.ids(begin + n) for n in range(len(rows))]
                    doc_ids = [None if null else x for x, null in zip(rows["doc_id"].tolist(), rows["no_id"].tolist())]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    columns = [longs(doc_ids), longs(rows["start"].astype(np.int64) + start), longs(rows["n"].astype(np.int64)), longs(crc)]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                shard.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    shards = manifest.select("file", "start").repartition("file")
    return shards.mapInArrow(decode, schema)
