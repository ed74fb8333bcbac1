"""Near-duplicates by SimHash: fingerprints of word shingles, compared as bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_schema, salts, stored
from .near_dedup import components, runs
from .tokens import slices, word_lists

WORDS, SEED, RADIUS = 3, 42, 3
CHUNK = 1 << 19  # bytes of text worked on at once
PIECE = 1 << 16  # hashes whose bits are counted at once
LARGE = 1 << 14  # members of a bucket that are compared with as many others in one place
LEVELS = 3  # how often a bucket is divided by further bits before it is compared in squares
PROBES = 1 << 12  # fingerprints of a block; each is compared with 64 others by one operation
U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``words`` words, repeats included; of all words of a shorter text; piece by piece."""
    hashed, kept, any_yet = xxhash.xxh64_intdigest, [], False
    for found in word_lists(text.lower()):  # bytes fold A-Z only
        kept += found
        if len(kept) >= words:
            joined, any_yet = b" ".join(kept), True
            sizes = np.fromiter(map(len, kept), np.int64, len(kept))
            ends = (sizes + 1).cumsum() - 1
            spans = zip((ends - sizes)[: len(kept) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
            yield np.fromiter((hashed(joined[a:b], seed) for a, b in spans), U, len(kept) - words + 1)
            kept = kept[len(kept) - words + 1 :]
    if kept and not any_yet:
        yield np.array([hashed(b" ".join(kept), seed)], U)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of ``sizes`` hashes the bits that are set in over half of them; 0 for an empty run."""
    counts, owner = np.zeros((len(sizes), 64), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + PIECE]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").reshape(-1).view(U)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fp (the 64 bits as a long). Whole texts; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            texts = [list(shingle_hashes(t or b"", words, seed)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([sum(map(len, t)) for t in texts], np.int64)
            flat = list(chain.from_iterable(texts))
            found = majorities(np.concatenate(flat) if flat else np.zeros(0, U), sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, id_schema(docs, "fp long"))


def planes(fp: np.ndarray) -> np.ndarray:
    """The fingerprints stored vertically: row p has bit p of all of them, 64 fingerprints a word."""
    bits = np.zeros((-(-len(fp) // 64) * 64, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U)


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set; n below 0 counts as 0, above 64 as 64."""
    n = np.clip(n, 0, 64)
    return np.where(n == 64, FULL, (U(1) << np.minimum(n, 63).astype(U)) - U(1))


def close_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), lo[i] <= j < hi[i], whose fingerprints differ in at most ``radius`` bits.

    Fingerprint i is a probe of the 64 lanes of a word. Plane by plane, its bit is compared with those of all lanes
    at once, and the differences are added into counters that are stored vertically too: full adders turn two
    differences and a counter's bit into a sum and a carry, carries go on to the counter's next bit in pairs, and a
    carry out of the last bit says that a lane is beyond the radius. Probes whose lanes all are get no further
    planes, and a block without other probes is left.
    """
    bits = max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius  # so that radius + 1 differences overflow
    plane, group = planes(fp), 1 << bits
    first, last = lo >> 6, (hi - 1) >> 6
    probes, step = np.flatnonzero(lo < hi), 0
    while len(probes):
        for block in np.split(probes, range(PROBES, len(probes), PROBES)):
            word, own = first[block] + step, fp[block]
            over = ~(_below(hi[block] - 64 * word) & ~_below(lo[block] - 64 * word))
            counter = [np.full(len(block), FULL if start >> k & 1 else U(0)) for k in range(bits)]
            for p in range(0, 64, group):
                diffs = [plane[q][word] ^ (U(0) - (own >> U(q) & U(1))) for q in range(p, p + group)]
                for k in range(bits):
                    carries = []
                    for x, y in zip(diffs[::2], diffs[1::2], strict=True):
                        half = x ^ y
                        carries.append((x & y) | (half & counter[k]))
                        counter[k] = half ^ counter[k]
                    diffs = carries
                over |= diffs[0]
                near = np.flatnonzero(over != FULL)
                if not len(near):
                    break
                if 4 * len(near) < 3 * len(over):
                    block, word, own, over, counter = block[near], word[near], own[near], over[near], [c[near] for c in counter]
            else:
                k, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield block[k], 64 * word[k] + lane
        step += 1
        probes = probes[first[probes] + step <= last[probes]]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of ``root`` that the pairs (i, j) link; each place then has its tree's smallest place."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def forest(places: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join what is close in some place. ``places`` are (g, side, fp).

    In a place g those of side 0 meet those of side 1, those of side 2 meet each other. Of all close pairs of some
    places only as many are returned as join the same fingerprints: fewer than there are rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            g, side, fp = (b.column(c).to_numpy() for c in ("g", "side", "fp"))
            n = len(g)
            ends = lambda x: np.append(np.flatnonzero((g[1:] != g[:-1]) | (x[1:] != x[:-1])) + 1, n)
            own = ends(side)
            end_of_side = own[np.searchsorted(own, np.arange(n), "right")]
            end_of_place = (every := ends(np.zeros(n)))[np.searchsorted(every, np.arange(n), "right")]
            past = np.minimum(end_of_side, n - 1)
            other = np.where((side == 0) & (end_of_side < end_of_place) & (side[past] == 1), end_of_side[past], end_of_side)
            lo = np.where(side == 2, np.arange(n) + 1, end_of_side)
            hi = np.where(side == 2, end_of_side, np.where(side == 0, other, end_of_side))
            root = np.arange(n)
            for i, j in close_pairs(fp.view(U), lo, hi, radius):
                joined(root, i, j)
            linked = np.flatnonzero(root != np.arange(n))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    return places.select("g", "side", "fp").repartition("g").sortWithinPartitions("g", "side").mapInArrow(run, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def divided(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` shares of the bits that it lacks."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(vertices: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all of ``vertices`` (fp, distinct) that differ in at most ``radius`` bits from another.

    Of radius + 1 shares of the bits a close pair has one in common, so those with equal shares meet in a bucket. A
    bucket of over LARGE members is divided in the same way by the bits that are left, up to LEVELS times; one that
    is still larger is cut into parts, and two parts meet in a place of their own. No bucket is left out.
    """
    level, masks, found = vertices.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    for depth in range(LEVELS):
        shares = {m: divided(m, radius + 1) for m in masks}
        step = None
        for m, more in shares.items():
            choice = F.array(*[F.lit(_signed(x)).cast("long") for x in more])
            step = F.when(F.col("mask") == _signed(m), choice) if step is None else step.when(F.col("mask") == _signed(m), choice)
        rows = level.select("fp", F.explode(step).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = stored(rows.join(sizes, ["mask", "key"]), "buckets")
        small, large = rows.where(F.col("n") <= LARGE), rows.where(F.col("n") > LARGE)
        found.append(small.select(F.xxhash64("mask", "key").alias("g"), F.lit(2).alias("side"), "fp"))
        masks, level = [x for more in shares.values() for x in more], large
        if large.isEmpty():
            break
    else:
        parts = F.ceil(F.col("n") / LARGE)
        own = level.withColumn("own", F.pmod(F.xxhash64("fp"), parts))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        found.append(met.select(F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), side.alias("side"), "fp"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return forest(every, radius)


def near_components(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach).

    Words are cut at ASCII white space of the whole text, A-Z lowered; each three in a row, repeats included, are
    hashed by XXH64, and a bit of the fingerprint is 1 if it is set in over half of the hashes. Distinct fingerprints
    are what is compared, bit plane by bit plane, so a group of copies of any size is one; ``links`` finds all that
    differ in at most ``radius`` bits, and a component is what links join, over any number of steps.

    Null and empty texts, and those of white space, have fingerprint 0 and are linked to texts within the radius of
    it like any other. Very long texts are hashed piece by piece. Rows that repeat each get a row; a null id counts
    for no component unless all ids of it are null. An empty table gives no rows. Columns other than doc_id and text
    are not looked at, whatever they are called.
    """
    spark = docs.sparkSession
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts(spark))).cast("int").alias("salt")
    rows = stored(fingerprints(docs, words, seed).select("*", salt), "fingerprints")
    vertices = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "vertices")
    classes = components(links(vertices, radius)).withColumnRenamed("id", "fp")
    own = vertices.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    own = own.join(own.groupBy("class").agg(F.min("first").alias("component_id")), "class").select("fp", "component_id")
    # A fingerprint that many rows have is looked up by each of its salts.
    own = rows.select("fp", "salt").distinct().join(own, "fp")
    found = rows.join(own, ["fp", "salt"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
