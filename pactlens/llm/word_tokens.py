"""Token ids of whole texts for tokenizers that drop white space, word by word with a bounded memory of words.

Such a tokenizer never joins characters across white space, so a text's ids are those of its words, one after another.
Letters A-Z are lowered first, which lets more words repeat. The tokenizer composes (NFC) before it lowers, and some marks
compose with a small letter but not with its capital; where a text holds such marks, only pure ASCII words are lowered here.
A full stop or comma between an a-z letter and white space is a token of its own and is cut off first, which lets more
words repeat. Words not yet known are encoded by the tokenizer itself, in bulk: many in one text, with a mark between them that
is one id on its own; where the ids hold another number of marks than were put there, word by word.

A worker remembers words in two generations. When the young one is full it becomes the old one, whose words come back as
they are met, so that frequent words are never learned again.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from pactlens.llm.common import remembered

KNOWN = 680_000  # words of a generation; a worker remembers two. A dictionary of over 699,050 takes twice the room
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")
_BULK, _PART = 4096, 1 << 20
_MARKS = b"~^|"  # one of these stands between words


class WordEncoder:
    """Ids as little-endian numbers of `width` bytes."""

    def __init__(self, path: str, width: int = 2):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.kind = np.dtype(f"<u{width}")
        if self._tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 8 * width:
            raise ValueError(f"ids of {path} need more than {width} bytes")
        self._known: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._mark, self._mark_id = next(
            ((mark, found[1]) for mark in map(bytes, zip(_MARKS)) if len(found := self._ids([b"a " + mark + b" a"])[0]) == 3 and found[0] == found[2]), (b"", 0)
        )

    def words(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # a special token's own case counts
            return _STOP.sub(rb" \1", text).split()
        if b"\xcc" in text or b"\xcd" in text:  # first bytes of U+0300 to U+036F, all marks that compose with A-Z or a-z
            return [word.lower() if word.isascii() else word for word in _STOP.sub(rb" \1", text).split()]
        return _STOP.sub(rb" \1", text.lower()).split()  # A-Z only; the tokenizer lowers the rest

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Each text's ids; the new words of about a megabyte of text are learned together."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(self.words(text))
            size += len(text)
            if size >= _PART:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, lists: list[list[bytes]]) -> Iterator[bytes]:
        if len(self._known) > KNOWN:
            self._known, self._old = {}, self._known
        new = []
        for word in set().union(*lists).difference(self._known):
            ids = self._old.get(word)
            if ids is None:
                new.append(word)
            else:
                self._known[word] = ids
        self._learn(new)
        for words in lists:
            yield b"".join(map(self._known.__getitem__, words))

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [found.ids for found in self._tokenizer.encode_batch_fast([text.decode() for text in texts], add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        # A special token, a combining mark or the mark itself could reach over a word's edge.
        odd = [word for word in words if self._mark in word or b"<|" in word or not word.isascii() and unicodedata.combining(word.decode()[0])]
        usual = words if not odd else list(set(words).difference(odd))
        for n in range(0, len(usual), _BULK):
            part = usual[n : n + _BULK]
            ids = np.array(self._ids([(b" " + self._mark + b" ").join(part)])[0], np.int64)
            marks = np.flatnonzero(ids == self._mark_id)
            if len(marks) != len(part) - 1:
                odd += part
                continue
            raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
            begins, ends = [0, *(size * (marks + 1)).tolist()], [*(size * marks).tolist(), len(raw)]
            self._known.update(zip(part, (raw[a:b] for a, b in zip(begins, ends))))
        for n in range(0, len(odd), _BULK):
            part = odd[n : n + _BULK]
            self._known.update(zip(part, (np.array(ids, self.kind).tobytes() for ids in self._ids(part))))


@functools.cache
def encoder(path: str, width: int = 2) -> WordEncoder:
    """One encoder for a worker's life, so that words are learned once for many tasks."""
    remembered(encoder.cache_clear)
    return WordEncoder(path, width)
