"""Stretches of a text in which a phrase repeats again and again, found by seeds that are extended along diagonals."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_schema
from .tokens import slices, word_lists

LEAST, TIMES = 6, 4  # a run has at least so many words and so many periods
CHUNK = 1 << 19  # bytes of text worked on at once
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"


def rewritten(words: np.ndarray, doc_id: object) -> np.ndarray:
    """The words of a document, of which a tenth, told by a hash of the id, is made to repeat from some word on."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((words[:a], words[a + np.arange(n - a) % period]))


class Grams:
    """The places of words and of the grams (runs of k words) that occur more than once, with a number for each gram.

    Two grams have one number exactly if their words are equal: numbers come from sorting pairs of numbers of shorter
    grams, not from hashes. A gram can only repeat where its parts do, so longer ones are looked for there alone.
    """

    def __init__(self, words: np.ndarray):
        self.k, self.n = 1, len(words)
        self.name = np.full(self.n, -1)
        self._number(np.arange(self.n), words)

    def _number(self, at: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(at) else np.zeros(0, bool)
        group = new.cumsum() - 1
        often = np.bincount(group)[group] > 1 if len(at) else new
        self.name[:] = -1
        #: Places in order of grams, and within one from left to right.
        self.at, self.group = at[order][often], group[often]
        self.name[self.at] = self.group

    def lengthen(self, k: int) -> None:
        """To grams of k words, by steps that at most double them."""
        while self.k < k and len(self.at):
            step = min(k, 2 * self.k) - self.k
            at = np.sort(self.at)
            at = at[at + step < self.n]
            at = at[self.name[at + step] >= 0]
            self._number(at, self.name[at] * (self.name.max(initial=0) + 1) + self.name[at + step])
            self.k += step


def _same(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """How many words from ``at`` on, to ``end`` at most, equal those ``lag`` later."""
    done, size = at, 64
    while done + lag < end:
        to = min(done + size, end - lag)
        differ = np.flatnonzero(words[done:to] != words[done + lag : to + lag])
        if len(differ):
            return done + int(differ[0]) - at
        done, size = to, 2 * size
    return done - at


def _same_back(words: np.ndarray, at: int, lag: int, begin: int) -> int:
    """How many words before ``at``, from ``begin`` on at the earliest, equal those ``lag`` later."""
    done, size = at, 64
    while done > begin:
        to = max(begin, done - size)
        differ = np.flatnonzero(words[to:done] != words[to + lag : done + lag])
        if len(differ):
            return at - (to + int(differ[-1]) + 1)
        done, size = to, 2 * size
    return at - done


def runs(words: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of several documents' words; no word number is in two documents.

    A run of period q has an overlap with itself, q words on, of at least max(LEAST - q, (TIMES - 1) q) words. So
    periods up to the least overlap of all share seeds of that length, then the next periods up to the least overlap
    of the first of them, and so on: 5, 18, 57 words and three times more in each step. A seed is no shorter than the
    period, so a gram recurs within a run at multiples of the period only, and the pairs to look at are those of
    neighbouring occurrences: as many as there are places, however often a gram occurs. Seeds of a lag are gone
    through from left to right; one that starts before the furthest place that the lag has covered belongs to a run
    that is known. An extended stretch has no smaller period: its seed would have recurred within the lag.
    """
    found, furthest, grams, below, n = [], {}, Grams(words), 0, len(words)
    while True:
        k = min(max(LEAST - q, (TIMES - 1) * q) for q in range(below + 1, below + LEAST + 1))
        grams.lengthen(k)
        if not len(grams.at):
            return found
        i, j = grams.at[:-1], grams.at[1:]
        seed = (grams.group[1:] == grams.group[:-1]) & (j - i > below) & (j - i <= k)
        i, lag = i[seed], (j - i)[seed]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        # Of seeds that follow each other the first leads to all that they belong to.
        fresh = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (lag[1:] != lag[:-1]))) if len(i) else np.zeros(0, bool)
        for at, q in zip(i[fresh].tolist(), lag[fresh].tolist(), strict=True):
            if at < furthest.get(q, -1):
                continue
            doc = int(np.searchsorted(begins, at, "right")) - 1
            end = int(begins[doc + 1]) if doc + 1 < len(begins) else n
            start = at - _same_back(words, at, q, int(begins[doc]))
            stop = at + _same(words, at, q, end)  # where the overlap ends
            furthest[q] = stop
            if stop + q - start >= max(LEAST, TIMES * q):
                found.append((start, stop + q - start, q))
        below = k


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those after the first period of some run."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return edges[:-1].cumsum() == 0


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period in words, by start and period), collapsed_sha256.

    A run is a stretch of words with smallest period q, of at least LEAST words and TIMES periods, that no
    neighbouring word extends. Collapsed, the text keeps of each run the first period only; the digest is of its
    words joined by one space. With ``rewrite`` a tenth of all documents is made to repeat first, see ``rewritten``.

    Words are cut at ASCII white space of the whole text. A task works on some documents at a time and a row on its
    own text, so nothing is shuffled and no row depends on another; very long texts take some 100 bytes a word. Null
    and empty texts have no words and no runs, and their collapsed text is empty. Rows that repeat fare alike; a null
    id is hashed as an empty text. An empty table gives no rows. Columns other than doc_id and text are not looked
    at, whatever they are called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            columns, spelt, first = [], [], 0
            ids = b.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                number: dict[bytes, int] = {}
                words = array("q")
                for part in word_lists(text or b""):
                    words.extend([number.setdefault(w, len(number)) for w in part])
                words = np.frombuffer(words, np.int64) if words else np.zeros(0, np.int64)
                columns.append((rewritten(words, doc_id) if rewrite else words) + first)
                spelt.append(list(number))
                first += len(number)  # so that no number is in two documents
            sizes = np.array([len(c) for c in columns])
            begins = sizes.cumsum() - sizes
            # Documents without words begin where the next one does.
            some = np.flatnonzero(sizes)
            by_doc: list[list[tuple[int, int, int]]] = [[] for _ in ids]
            for start, length, period in runs(np.concatenate(columns), begins[some]):
                k = int(some[np.searchsorted(begins[some], start, "right") - 1])
                by_doc[k].append((start - int(begins[k]), length, period))
            out, low = [], 0
            for words, names, found in zip(columns, spelt, by_doc, strict=True):
                found.sort(key=lambda r: (r[0], r[2]))
                kept = words - low
                if found:
                    kept = kept[collapsed(len(kept), found)]
                out.append(hashlib.sha256(b" ".join([names[w] for w in kept.tolist()])).hexdigest())
                low += len(names)
            flat = list(chain.from_iterable(by_doc))
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            listed = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(r) for r in by_doc]), pa.int32()),
                pa.StructArray.from_arrays(fields, names=["start", "length", "period"]),
            )
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), listed, pa.array(out)], names=["doc_id", "n_words", "runs", "collapsed_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, id_schema(docs, RESULT))
