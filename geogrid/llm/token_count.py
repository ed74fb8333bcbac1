"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_schema
from .tokens import Memory, slices

END = 256  # the end of a word, a symbol beside the 256 bytes
_workers: dict[str, "Automaton"] = {}


class Automaton:
    """A trie of a vocabulary with failure links and, for each link, how many pieces it pops.

    Greedy word-piece length: from the left, always the longest piece of the vocabulary. Where the next symbol has
    no child, the node's failure link leads to the node of what is left after the longest pieces are taken off its
    string, and the number of those pieces is added to the count. Each symbol goes down the trie once, so a word
    takes linear time, and no piece is built.

    Pieces are strings of bytes, a piece that must end a word has END after them. If a piece is missing, so that a
    word can't be cut, it counts as one unknown token, as in word-piece models.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                at = self.child[at].get(s) or self._grow(at, s, ends)
            ends[at] = at > 0
        self.fail = [-1] * len(ends)
        self.popped = [0] * len(ends)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for s, u in self.child[v].items():
                if ends[u]:
                    self.fail[u], self.popped[u] = 0, 1
                else:
                    z, n = self.fail[v], self.popped[v]
                    while z >= 0 and s not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.popped[u] = self.child[z][s], n
                queue.append(u)
        self.memory = Memory()

    def _grow(self, at: int, s: int, ends: list[bool]) -> int:
        self.child.append({})
        ends.append(False)
        self.child[at][s] = len(ends) - 1
        return len(ends) - 1

    @classmethod
    def of(cls, path: str) -> "Automaton":
        """From a tokenizers file with byte letters and ``</w>``; the one of this worker process."""
        if path not in _workers:
            _workers[path] = cls(vocabulary(path))
        return _workers[path]

    def pieces(self, word: str) -> int:
        """Pieces of one word, 1 if it can't be cut; the automaton runs over its UTF-8 bytes and END."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for s in (*word.encode("utf-8", "replace"), END):
            while (to := child[at].get(s)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n if at == 0 else 1

    def count(self, text: str) -> tuple[int, int]:
        """Words of a text, cut at ASCII white space, and their pieces; case is folded first."""
        text = text.lower()
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = text.split(" ")
        new, known = self.memory.missing(set(words)), self.memory.known
        for w in new:
            known[w] = self.pieces(w) if w else 0
        found = len(words) - words.count(""), sum(map(known.__getitem__, words))
        self.memory.rest(new)
        return found


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The pieces of a vocabulary that spells bytes with letters and marks the end of a word with ``</w>``.

    Each piece may end a word, also one that the file has without ``</w>`` only: greedy pieces of a word can end on any.
    """
    from tokenizers import Tokenizer

    from .tokens import LETTERS

    byte = {chr(LETTERS.get(b, b)): b for b in range(256)}
    out = []
    for t in Tokenizer.from_file(path).get_vocab(with_added_tokens=False):
        body = t.removesuffix("</w>")
        if body and all(c in byte for c in body):
            out.append((*[byte[c] for c in body], *[END] * (len(body) < len(t))))
    return [*out, *sorted({(*x, END) for x in out if x[-1] != END}.difference(out))]


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens (greedy longest-match pieces of the whole text).

    Null and empty text have none. Rows are independent of one another: nothing is shuffled, and a repeated row is
    counted again; so ties cannot arise. A null id is returned as it is. Very long texts and words are counted whole.
    An empty table gives no rows. Columns other than doc_id and text are not looked at, whatever they are called.
    """
    from .packing import default_tokenizer

    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(path)
        for b in slices(batches, "text"):
            words, tokens = zip(*[automaton.count(t or "") for t in b.column("text").to_pylist()], strict=True)
            cols = [b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, id_schema(docs, "n_words long, n_tokens long"))
