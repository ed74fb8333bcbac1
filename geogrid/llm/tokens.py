"""Token ids of whole texts, word by word with a memory of the words seen."""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

# A worker remembers two generations of at most so many words of at most so many characters: some 40 MB.
MEMORY, LONGEST = 80_000, 40
# Byte-level vocabularies spell the bytes that don't print with the letters from U+0100 on, in order.
_DARK = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
LETTERS = {b: 256 + i for i, b in enumerate(_DARK)}
_workers: dict[str, "WordTokens"] = {}


class Memory:
    """What was worked out for words, bounded: words in use live on in the newer of two generations."""

    def __init__(self) -> None:
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of ``words`` that have to be worked out and put into ``known``."""
        out = []
        for w in words.difference(self.known):
            if (found := self.older.get(w)) is None:
                out.append(w)
            else:
                self.known[w] = found
        return out

    def rest(self, new: list[str]) -> None:
        """Called when a batch is done, with the words that were new to it."""
        for w in new:
            if len(w) > LONGEST:
                self.known.pop(w, None)
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known


class WordTokens:
    """Ids of a tokenizers file whose pre-tokenizer never joins what white space parts.

    Then the ids of a text are those of its words in turn, and only words not met lately go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory()

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        """The one of this worker process."""
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _learn(self, words: list[str]) -> None:
        known, made, odd, plain = self.memory.known, [], [], set()
        for w in words:
            # A full stop or comma after a letter is a token by itself, and case folds before anything else.
            core = w if w.isalpha() else w[:-1] if w[-1:] in (".", ",") and w[:-1].isalpha() else ""
            # Latin letters up to U+017F are composed already and lower one by one, but for the dotted I.
            if core and (core.isascii() or (max(core) < "\u0180" and "\u0130" not in core)):
                low = core.lower()
                made.append((w, low, w[len(core) :]))
                plain.add(low)
            else:
                odd.append(w)
        ids: dict[str, bytes] = {}
        # Letters only: one pre-token each, so they go straight to the merges, spelt in the vocabulary's byte letters.
        merge = self.tokenizer.model.tokenize
        for word in plain:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
            ids[word] = array.array("I", [t.id for t in merge(spelt)]).tobytes()
        odd += [".", ","]
        for word, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            known[word] = np.array(e.ids, "<u4").tobytes()
        for w, low, mark in made:
            known[w] = ids[low] + known[mark] if mark else ids[low]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = self.memory.missing(set().union(*split))
        if new:
            self._learn(new)
        ids = self.memory.known.__getitem__
        out = [b"".join(map(ids, words)) for words in split]
        self.memory.rest(new)
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one are of ``limit`` bytes or are a single row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        ends = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0)).cumsum()
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield b.slice(at, to - at)
            at = to


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text of UTF-8, cut at ASCII white space, in lists of about ``limit`` bytes of text."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + limit) if at + limit < len(text) else None
        to = found.start() if found else len(text)
        yield text[at:to].split()
        at = to
