"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix at two ranks of its units, and rearranged.

Units are lines: `[^\\n]*\\n|[^\\n]+`, left to right. Their index is an indexable skip list. Its lowest lane holds every unit, each
lane above it every FAN-th node of the lane below. A link carries the widths of what it skips: units, code points and bytes.
A cut at a rank goes along the highest lane while the link stays within the rank, then a lane down, and adds up the widths
on its way, so that it arrives with the exact code-point and byte place of the rank after a few links per lane.

The four numbers that decide come from the SHA-256 of `seed:doc_id`: the ranks (first two, modulo units + 1, smaller first),
whether the text is rearranged (third, percent) and in which form (fourth, percent).
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text: when it is empty, when it holds one of the marks, or when the third number says so
Marks must not overlap each other, so that the first occurrence of each in an output is the one put there.

Every document is handled alone, by one task, with no exchange; memory is a small multiple of the longest text.

Defined results: a null text is empty; a null doc_id gives the empty string after `seed:`; repeated rows give repeated
results; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm.common import ids_and_text, longs, texts

FAN = 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Marks(NamedTuple):
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def checked(self) -> Marks:
        """Itself, unless a mark could be read across the edge of another one or of a text."""
        for one in self:
            for two in self:
                if not one or (one is not two and one in two) or any(one.endswith(two[:n]) for n in range(1, len(two)) if n < len(one)):
                    raise ValueError(f"marks {one!r} and {two!r} overlap")
        return self


class Place(NamedTuple):
    units: int
    chars: int
    octets: int


class UnitIndex:
    """Indexable skip list over the lines of a text."""

    def __init__(self, text: bytes):
        octets = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(octets == 10) + 1
        if len(octets) and (not len(ends) or ends[-1] != len(octets)):
            ends = np.append(ends, len(octets))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        chars = np.add.reduceat((octets & 0xC0) != 0x80, starts, dtype=np.int64) if len(ends) else ends
        self.units = len(ends)
        lanes = [(np.ones(self.units, np.int64), chars, ends - starts)]
        while len(lanes[-1][0]) > FAN:
            nodes = np.arange(0, len(lanes[-1][0]), FAN)
            lanes.append(tuple(np.add.reduceat(widths, nodes) for widths in lanes[-1]))
        self._lanes = lanes[::-1]

    def cut(self, rank: int) -> Place:
        """Where the first `rank` units end."""
        node = units = chars = octets = 0
        for unit_widths, char_widths, octet_widths in self._lanes:
            node *= FAN
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += int(unit_widths[node])
                chars += int(char_widths[node])
                octets += int(octet_widths[node])
                node += 1
        return Place(units, chars, octets)


class Transformed(NamedTuple):
    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[n : n + 4], "big") for n in (0, 4, 8, 12)]


def rearrange(doc_id: int | None, text: bytes, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Marks = Marks()) -> Transformed:
    index = UnitIndex(text)
    one, two, whether, which = draws(doc_id, seed)
    if not text or whether % 100 >= rate or any(mark in text for mark in marks):
        return Transformed(index.units, PLAIN, None, None, text)
    first, last = (index.cut(rank) for rank in sorted((one % (index.units + 1), two % (index.units + 1))))
    prefix, middle, suffix = text[: first.octets], text[first.octets : last.octets], text[last.octets :]
    if which % 100 < spm_rate:
        form, parts = SPM, (marks.suffix, suffix, marks.prefix, prefix)
    else:
        form, parts = PSM, (marks.prefix, prefix, marks.suffix, suffix)
    return Transformed(index.units, form, first.chars, last.chars - first.chars, b"".join((*parts, marks.middle, middle)))


def restore(output: bytes, form: str, marks: Marks = Marks()) -> bytes:
    """The text that gave `output`."""
    if form == PLAIN:
        return output
    head, second = (marks.prefix, marks.suffix) if form == PSM else (marks.suffix, marks.prefix)
    if not output.startswith(head):
        raise ValueError(f"not an output of form {form}")
    left, _, rest = output[len(head) :].partition(second)
    right, _, middle = rest.partition(marks.middle)
    prefix, suffix = (left, right) if form == PSM else (right, left)
    return prefix + middle + suffix


def transform(
    documents: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, marks: Marks = Marks(), with_text: bool = False
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and digests of the output and of the restored text.

    `rate` and `spm_rate` are percentages: of texts that are rearranged, and of these in form spm. `with_text` adds the
    output itself.
    """
    marks.checked()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rearrange(i, text, seed, rate, spm_rate, marks) for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch))]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": longs([x.units for x in made]),
                "form": pa.array([x.form for x in made], pa.string()),
                "prefix_chars": longs([x.prefix_chars for x in made]),
                "middle_chars": longs([x.middle_chars for x in made]),
                "output_sha256": pa.array([hashlib.sha256(x.output).hexdigest() for x in made], pa.string()),
                "restored_sha256": pa.array([hashlib.sha256(restore(x.output, x.form, marks)).hexdigest() for x in made], pa.string()),
            }
            if with_text:
                columns["output"] = pa.array([x.output for x in made], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return ids_and_text(documents).mapInArrow(run, schema + ", output string" * with_text)
