"""Byte-pair encoding and decoding of whole texts, split at forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be joined: no merge spans it. A text may be cut
there, its fragments encoded one by one, and the ids put end to end. Pairs inside special tokens count as occurring, so these
are never cut. The tokenizer also looks at characters before it merges (it groups letters, digits, marks and white space), so
a cut is used only where that grouping cannot change either: between whole characters, not after white space, whose
grouping depends on what follows, and not before an apostrophe, which may open a contraction.

A cut almost always lies between a word and the blank after it, so fragments are words with the blank or mark
before them, and repeat. A worker remembers the ids of a bounded number of fragments, and unknown ones are
encoded in bulk by the tokenizer library. Decoding puts the tokens' bytes end to end, and stands in U+FFFD for what is not UTF-8.

Defined results: a null text is empty and has no ids. Repeated rows stay repeated, extra columns are not read. A very long
text is encoded by one task, which holds its fragments; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm.common import ids_and_text, longs, texts

KNOWN = 500_000  # fragments a worker remembers
LONGEST = 64  # bytes of a remembered fragment
_BULK, _PART = 512, 1 << 20
_MARK = 0xFF  # a byte that UTF-8 never uses; marks cuts
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + n): byte for n, byte in enumerate(others)}


class ForcedBoundaryEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        if described["pre_tokenizer"]["type"] != "ByteLevel" or described["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level tokenizer without added blanks")
        alphabet = byte_alphabet()
        special = {token["id"]: token["content"].encode() for token in described["added_tokens"]}
        tokens = {i: bytes(map(alphabet.__getitem__, t)) for t, i in described["model"]["vocab"].items() if i not in special} | special
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.cuts = self._forced(self.tokens)
        self._known: dict[bytes, bytes] = {}

    @staticmethod
    def _forced(tokens: Iterable[bytes]) -> np.ndarray:
        """Table by (byte, next byte): whether a text is certainly cut between them."""
        apart = np.ones((256, 256), bool)
        for token in tokens:
            pairs = np.frombuffer(token, np.uint8)
            apart[pairs[:-1], pairs[1:]] = False
        apart[:, 0x80:0xC0] = False  # inside a character
        apart[:, ord("'")] = False
        ascii_space = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
        # Last bytes of U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
        other_space = [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
        apart[ascii_space + other_space] = False
        return apart.reshape(-1)

    def fragments(self, text: bytes) -> list[bytes]:
        values = np.frombuffer(text, np.uint8)
        if len(values) < 2:
            return [text] if text else []
        cut = np.flatnonzero(self.cuts[values[:-1].astype(np.uint16) << 8 | values[1:]])
        return np.insert(values, cut + 1, _MARK).tobytes().split(b"\xff")

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; about a megabyte of text is taken at a time."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(self.fragments(text))
            size += len(text)
            if size >= _PART:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, lists: list[list[bytes]]) -> Iterator[bytes]:
        if len(self._known) > KNOWN:
            self._known.clear()
        new = list(set().union(*lists).difference(self._known))
        long_ones: dict[bytes, bytes] = {}
        for n in range(0, len(new), _BULK):
            part = new[n : n + _BULK]
            for fragment, found in zip(part, self._tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)):
                (self._known if len(fragment) <= LONGEST else long_ones)[fragment] = np.array(found.ids, "<u4").tobytes()
        for fragments in lists:
            if long_ones:
                yield b"".join([long_ones[x] if len(x) > LONGEST else self._known[x] for x in fragments])
            else:
                yield b"".join(map(self._known.__getitem__, fragments))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder for a worker's life."""
    return ForcedBoundaryEncoder(path)


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw, "<u4").astype(np.int32).tolist() for raw in encoder(tokenizer).encode_all(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_text(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text from the ids of `encode`; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoder(tokenizer).decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the text that they decode to, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = encoder(tokenizer)
            counts, digests, decoded = [], [], []
            for ids in held.encode_all(texts(batch)):
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(held.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), longs(counts), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids_and_text(documents).mapInArrow(run, ENCODED)
