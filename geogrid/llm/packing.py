"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_schema, stored
from .tokens import WordTokens, slices

PIECE = "piece int, start long, length long, tokens binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end_id: int = 1) -> DataFrame:
    """The documents' tokens in pieces of at most ``size``: doc_id, piece, start, length, tokens.

    ``tokens`` holds little-endian unsigned 32-bit ids. A document is the ids of its whole text and then ``end_id``;
    null text counts as empty, so each document has a token at least. Only documents longer than ``size`` are cut.
    Texts of any length are read whole. Ids keep their type, null ids and rows that repeat give pieces of their own,
    an empty table gives none, and columns other than doc_id and text are not looked at, whatever they are called.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(path)
        for b in slices(batches, "text"):
            ids = [x + end for x in words.encode([t or "" for t in b.column("text").to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], "int64")
            pieces = -(-n // size)
            row = np.repeat(np.arange(len(ids)), pieces)
            piece = np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            tokens = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(tokens, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, id_schema(docs, PIECE))


class Plan:
    """Where the pieces of each length go, as runs of ranks.

    A run says: pieces of ``length`` with ranks from ``rank`` on, ``per`` of them to a sequence, begin at sequence
    ``sequence`` and offset ``offset``. Lengths are whole numbers up to ``size``, so the whole instance is a count
    for each length; its size does not depend on the number of pieces.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left = size, dict(counts)
        self.next_rank = dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()
        self.runs.sort()

    def _place(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], per, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _fix(self, parts: list[int], times: int) -> None:
        """``times`` sequences, each of these lengths, are closed for good."""
        at, k = 0, 0
        parts = sorted(parts, reverse=True)
        while k < len(parts):
            per = parts.count(parts[k])
            self._place(parts[k], times * per, per, self.sequences, at)
            at += per * parts[k]
            k += per
        self.sequences += times
        self.fixed += times

    def _dominant(self, j: int, present: list[int]) -> list[int] | None:
        """A set with j that dominates all other sets with j, if one can be told; present: lengths left, rising.

        Martello and Toth: j alone if nothing fits beside it; j with the largest k that fits if k fills up the rest,
        if no two pieces fit beside j, or if no such pair is larger than k; j with k and the largest b beside them if
        no three fit and no pair's smaller part is larger than b.
        """
        room = self.size - j
        lengths = present[: bisect.bisect_right(present, room)]
        if j <= room and self.left[j] == 1:
            lengths.remove(j)
        if not lengths:
            return [j]
        k = lengths[-1]
        if k == room:
            return [j, k]
        many = lambda x: self.left[x] - (x == j)
        low = [x for x in lengths[:3] for _ in range(min(many(x), 3))][:3]
        if len(low) < 2 or low[0] + low[1] > room:
            return [j, k]
        three = len(low) == 3 and sum(low) <= room
        partner = lengths[bisect.bisect_right(lengths, room - low[0]) - 1]
        if three and low[0] + partner > k and (partner > low[0] or many(low[0]) > 1):
            return None  # a pair is larger than k, and three fit: no rule applies
        best, smaller = 0, 0
        for p in lengths:  # the largest partner of p, so that the pair fits
            q = bisect.bisect_right(lengths, min(room - p, p)) - 1
            if q >= 0 and lengths[q] == p and many(p) < 2:
                q -= 1
            if q >= 0:
                best, smaller = max(best, p + lengths[q]), max(smaller, lengths[q])
        if k >= best:
            return [j, k]
        if not three:
            beside = [x for x in lengths if x <= room - k and (x != k or many(x) > 1)]
            if beside and beside[-1] >= smaller:
                return [j, k, beside[-1]]
        return None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            present = sorted(x for x, n in self.left.items() if n > 0)
            for j in present[::-1]:
                while self.left[j] > 0:
                    parts = self._dominant(j, present)
                    if parts is None:
                        break
                    # The reason holds until one of the lengths is used up, so as many are fixed at once.
                    times = min(self.left[x] // parts.count(x) for x in parts)
                    self._fix(parts, max(1, times))
                    before, present = present, [x for x in present if self.left[x] > 0]
                    changed = changed or len(before) > len(present)

    def _best_fit(self) -> None:
        """Best fit, lengths falling; sequences of one room are kept as ranges of numbers."""
        rooms: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n > 0 and room > 0:
                if room not in rooms:
                    rooms[room] = []
                    bisect.insort(order, room)
                rooms[room].append((first, n))

        for x in sorted((x for x, n in self.left.items() if n > 0), reverse=True):
            while self.left[x]:
                at = bisect.bisect_left(order, x)
                if at < len(order):
                    room = order[at]
                    first, n = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[at]
                else:
                    room, first, n = self.size, self.sequences, -(-self.left[x] // (self.size // x))
                    self.sequences += n
                each = min(room // x, self.left[x])
                full = min(n, self.left[x] // each)
                self._place(x, full * each, each, first, self.size - room)
                add(room - each * x, first, full)
                rest = min(self.left[x], each) if full < n else 0
                if rest:
                    self._place(x, rest, rest, first + full, self.size - room)
                    add(room - rest * x, first + full, 1)
                add(room, first + full + bool(rest), n - full - bool(rest))


def packed(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence holds more than ``size`` tokens, with no gaps.

    ``pieces`` has a ``length`` of 1 to ``size`` and whatever else; a null or other length raises an error. The
    lengths' counts, at most ``size`` numbers, are all that the driver gets; it plans the sequences as runs of ranks
    (``Plan``). Each piece then has a rank among those of its length, counted up block by block, so a length that a
    third of all pieces have is spread over all blocks. Pieces of one length are exchangeable, so ties and repeated
    rows need no rule. An empty table gives no rows. Columns called ``sequence_id`` or ``offset`` are replaced.
    """
    given = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ok = F.col("length").between(1, size)
    checked = pieces.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.lit("bad length")).cast("long")))
    slim = stored(checked.select(*given, F.spark_partition_id().alias("__block"), F.monotonically_increasing_id().alias("__nth")), "pieces")
    blocks = stored(slim.groupBy("length", "__block").agg(F.count("*").alias("__n")), "lengths")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    runs = Plan(counts, size).runs
    table = np.array(runs or [(0, 0, 1, 0, 0)], "int64").T.copy()
    big = np.int64(1) << 48
    keys = table[0] * big + table[1]

    earlier = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("length", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__block").orderBy("__nth")
    # Never broadcast: the table of first ranks has a row for each length of each block, and blocks grow with the input.
    ranked = slim.withColumn("__rank", F.row_number().over(within) - 1).join(first.hint("merge"), ["length", "__block"])
    ranked = ranked.select(*given, (F.col("__rank") + F.col("__first")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.asarray(b.column("length")).astype("int64")
            rank = np.asarray(b.column("__rank"))
            at = np.searchsorted(keys, length * big + rank, "right") - 1
            nth = rank - table[1][at]
            cols = [b.column(c) for c in given]
            cols += [pa.array(table[3][at] + nth // table[2][at]), pa.array(table[4][at] + nth % table[2][at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*given, "sequence_id", "offset"])

    schema = ranked.select(*given, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(place, schema)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, tokens, doc_ids) of packed pieces that carry their tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens", "doc_id")))
    x = packed_pieces.groupBy("sequence_id").agg(parts.alias("p"))
    tokens = F.aggregate("p", F.lit(b""), lambda a, y: F.concat(a, y["tokens"]))
    return x.select("sequence_id", tokens.alias("tokens"), F.col("p.doc_id").alias("doc_ids"))
