"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import id_schema, named, salts, stored
from .tokens import slices

BLOCK = 1 << 15
ROWS = 512  # members of a bucket, or of those with a common rare shingle, that are compared with as many others at once
BYTES = 4 << 20  # of text, likewise
BINS = 256  # of a text's weight, by the hash of its shingles
MANY = 1 / 16  # of a block, from which on bins are looked up


@dataclass(frozen=True)
class Settings:
    """``similarity`` is the least weighted Jaccard similarity of a link. ``bands`` of ``rows`` samples each make
    candidates: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^3)^10 = 0.999, one of 0.9 always.
    Candidates whose samples agree less than ``agreement`` are not verified; a linked pair falls below it less than
    once in a thousand. Shingles in more than ``common`` of all documents weigh less, down to 1; rarer ones weigh
    1 - ln(common)."""

    similarity: float = 0.8
    bands: int = 10
    rows: int = 3
    agreement: float = 0.55
    common: float = 0.1


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket of shingles occurs, and the number of documents.

    Every document counts. There are 2^20 buckets at any input size: the few hundred shingles of a text are spread
    thinly over them, so that a bucket's count stands out only through shingles that many documents share, and those
    alone change a weight. A task sends one compressed table; tables are added up as they stream in, first those of
    one salt, then each block of those sums, so no task ever holds more than one table.
    """

    def packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        full = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(total.reshape(-1, BLOCK)) if x.any()]
        if full:
            blocks, counts = zip(*full, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())], names=["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(S.BUCKETS, np.int64)
        for b in slices(batches, "text", S.CHUNK):
            h, _, _ = S.shingled(b.column("text"))
            total += np.bincount(S.bucket(h), minlength=S.BUCKETS)
        yield from packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(S.BUCKETS, np.int64)
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
                total[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield from packed(total)

    schema = "block int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts(docs.sparkSession))).alias("salt")
    sums = parts.select("*", salt).repartition("salt").select("block", "counts").mapInArrow(add, schema)
    found = np.zeros(S.BUCKETS, np.int64)
    for r in sums.repartition("block").mapInArrow(add, schema).collect():
        found[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return found, docs.count()


def rarity(counts: np.ndarray) -> np.ndarray:
    """The place of each bucket of shingles in the order from rare to frequent, in eighths of a power of two."""
    return np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)


def inverse_frequencies(docs: DataFrame, common: float) -> np.ndarray:
    """1 + ln(documents / documents with the bucket), at most 1 - ln(common)."""
    return inverse(*frequencies(docs), common)


def inverse(counts: np.ndarray, n: int, common: float) -> np.ndarray:
    return (1 + np.log(max(n, 1) / np.clip(counts, max(1, common * n), max(n, 1)))).astype(np.float32)


def content(text: Column) -> Column:
    """What stands for a whole text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def signatures(docs: DataFrame, idf: np.ndarray, settings: Settings) -> DataFrame:
    """Per row: doc_id, content, bands (array of hashes, empty without words), samples, size (bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    n = settings.bands * settings.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", S.CHUNK):
            texts = b.column("text").fill_null("")
            h, times, sizes = S.shingled(texts)
            sig = S.sampled(h, S.weights(h, times, shared.value), sizes, n)
            bands = np.zeros((len(sig), settings.bands), np.uint64)
            for k in range(settings.rows):
                bands = S.mixed(bands + sig[:, k :: settings.rows])
            full = np.where(sizes > 0, settings.bands, 0)
            flat = pa.array(bands[sizes > 0].reshape(-1).view(np.int64))
            small = np.ascontiguousarray((S.mixed(sig) >> np.uint64(32)).astype(np.uint32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("content"),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], full.cumsum())), pa.int32()), flat),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                    pa.compute.binary_length(texts).cast(pa.int64()),
                ],
                names=["doc_id", "content", "bands", "samples", "size"],
            )

    rows = docs.select("doc_id", content(F.col("text")).alias("content"), "text")
    return rows.mapInArrow(run, id_schema(docs, "content binary, bands array<long>, samples binary, size long"))


def agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, sa, sb) whose samples agree in at least ``least`` of all places: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                ok = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def verified_with_leaders(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, its leader b) whose texts have at least this weighted Jaccard similarity: a, b, similarity.

    The members of one leader are dealt over salts; the leader's text goes to each salt that has members, and theirs
    stream past it, so a leader of any number of members is spread and only its own shingles are kept.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    keyed = pairs.withColumn("g", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(salts(pairs.sparkSession)))))
    leaders = keyed.select("g", F.col("b").alias("id")).distinct().withColumn("kind", F.lit(0))
    rows = leaders.unionByName(keyed.select("g", F.col("a").alias("id"), F.lit(1).alias("kind"))).join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for part in slices(batches, "text", S.CHUNK):
            h, times, sizes = S.shingled(part.column("text"))
            w, ends = S.weights(h, times, shared.value), sizes.cumsum()
            found = []
            for kind, x, end, n in zip(part.column("kind").to_pylist(), part.column("id").to_pylist(), ends, sizes, strict=True):
                this = h[end - n : end], w[end - n : end]
                if kind == 0:
                    leader, own = x, tuple(map(np.copy, this))
                elif (s := S.similarity(this, own)) >= least:
                    found.append((x, leader, s))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b", "similarity"])

    return rows.select("g", "kind", "id", "text").repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, "a long, b long, similarity double")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, sorted by their first column, cut so that no value of it is in two of them."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        g = b.column(0).to_numpy()
        if kept and kept[-1].column(0)[-1].as_py() != g[0]:
            yield pa.concat_batches(kept)
            kept = []
        at = int(np.searchsorted(g, g[-1]))
        if at:
            yield pa.concat_batches([*kept, b.slice(0, at)])
            kept = []
        kept.append(b.slice(at))
    if kept:
        yield pa.concat_batches(kept)


def rare_shingles(texts: DataFrame, idf: np.ndarray, order: np.ndarray, least: float) -> DataFrame:
    """The rarest shingles of each text (id, class, text), so many that texts alike by ``least`` have one in common.

    Two texts of weights W and V have a similarity of ``least`` only if what they share weighs
    least / (1 + least) * (W + V). Shingles are put in one order, rare ones first. All that two texts share comes at or
    after the first shingle that they share, so if c of W comes before it, V is at most ``top`` =
    (1 + least) / least * (W - c) - W, and W is bounded likewise. Shingles whose ``top`` is below least * W can't be the
    first of any pair. Rows are (s, id, class, weight, top, load, bins); ``load`` is the text's part of a block of ROWS
    rows and BYTES bytes. ``bins``, in the first row of a text only, are BINS sums of its weights by the shingle's hash,
    a byte each, in units of the greatest weight of one shingle and rounded up; 255 is that much or more.
    """
    spark = texts.sparkSession.sparkContext
    shared, ranks = spark.broadcast(idf), spark.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", S.CHUNK):
            h, times, sizes = S.shingled(part.column("text"))
            w, rank = S.weights(h, times, shared.value), ranks.value[S.bucket(h)]
            bins = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BINS + (h % S.U(BINS)).astype(np.int64), w, BINS * len(sizes))
            bins = np.minimum(np.ceil(bins / shared.value.max() - 1e-9), 255).astype(np.uint8).reshape(-1, BINS)
            names, tops, totals, first = [], [], [], []
            for end, n in zip(sizes.cumsum(), sizes, strict=True):
                own = slice(end - n, end)
                o = np.lexsort((h[own], rank[own]))
                total, after = w[own].sum(), w[own][o][::-1].cumsum()[::-1]
                top = (1 + least) / least * after - total + 1e-9 * total  # sums in another order don't decide
                k = int((top >= least * total).sum())
                names.append(h[own][o[:k]])
                tops.append(top[:k])
                totals.append(np.full(k, total))
                first += [bins[len(names) - 1].tobytes(), *[None] * (k - 1)][:k]
            at = np.repeat(np.arange(len(names)), [len(x) for x in names])
            load = 1 / ROWS + pa.compute.binary_length(part.column("text")).fill_null(0).to_numpy() / BYTES
            columns = [np.concatenate(names).view(np.int64), part.column("id").to_numpy()[at], part.column("class").to_numpy()[at]]
            columns += [np.concatenate(totals), np.concatenate(tops), load[at]]
            columns = [*map(pa.array, columns), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["s", "id", "class", "weight", "top", "load", "bins"])

    return texts.select("id", "class", "text").mapInArrow(run, "s long, id long, class long, weight double, top double, load double, bins binary")


def meetings(rare: DataFrame) -> DataFrame:
    """The rows of ``rare_shingles`` that can be of a pair of two classes, at each place g where they meet others: side 0 or 1.

    Of a pair the lighter text is ``wide`` at the first shingle that both have: its ``top`` is at least its own weight.
    So a shingle counts only where texts of two classes have it, one of them wide, and those that are not wide don't
    meet each other. A shingle with more than a block's load is cut by class, a class of more than a block into its own
    parts, which don't meet each other either; two parts meet once, so none is left out. ``many`` tells places of a
    shingle with more than MANY.
    """
    rare = rare.withColumn("wide", F.col("top") >= F.col("weight"))
    of_class = rare.groupBy("s", "class").agg(F.sum("load").alias("own"), F.max("wide").alias("any"))
    of_shingle = of_class.groupBy("s").agg(F.sum("own").alias("all"), F.min("class").alias("x"), F.max("class").alias("y"), F.max("any").alias("any"))
    of_shingle = of_shingle.where("any and x <> y").select("s", "all")
    large = stored(of_class.where("own > 1").select("s", "class", "own"), "large")
    parts = F.when(F.col("own").isNotNull(), F.xxhash64("class", F.pmod(F.xxhash64("id"), F.ceil("own")))).otherwise(F.pmod(F.xxhash64("class"), F.ceil("all")))
    part = F.when(F.col("all") <= 1, F.struct(F.lit(True).alias("wide"), F.lit(0).cast("long").alias("part"))).otherwise(F.struct("wide", parts.alias("part")))
    rows = rare.join(of_shingle, "s").join(large, ["s", "class"], "left").withColumn("part", part)
    rows = stored(rows.select("s", "part", "id", "class", "weight", "top", (F.col("all") > 1).alias("cut"), (F.col("all") > MANY).alias("many")), "rare")
    alone = rows.where("not cut").select(F.col("s").alias("g"), F.lit(0).alias("side"), "id", "class", "weight", "top", "many")

    present = rows.where("cut").groupBy("s", "part").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    x = present.select("s", F.col("part").alias("x"), F.col("lo").alias("xl"), F.col("hi").alias("xh"))
    y = present.select("s", F.col("part").alias("y"), F.col("lo").alias("yl"), F.col("hi").alias("yh"))
    places = x.join(y, "s").where("x <= y and (x.wide or y.wide) and least(xl, yl) < greatest(xh, yh)")
    sides = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    places = places.select("s", F.xxhash64("s", "x", "y").alias("g"), F.posexplode(sides).alias("side", "part"))
    return alone.unionByName(rows.where("cut").join(places, ["s", "part"]).select("g", "side", "id", "class", "weight", "top", "many"))


def within_reach(met: DataFrame, bins: DataFrame, unit: float, least: float) -> DataFrame:
    """The pairs of ``meetings`` of different classes that are in reach of each other: a, b, and one g of theirs.

    Both weights must be within the other's ``top``. In places of many, what a pair shares weighs at most the sum of the
    lesser of its ``bins`` (id, bins), of ``unit``: where that is too little for ``least``, so is the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches):
            g, side, ids, classes, weight, top = (b.column(c).to_numpy() for c in ("g", "side", "id", "class", "weight", "top"))
            known = b.column("bins").is_valid().to_numpy(zero_copy_only=False)
            binned = np.full((len(g), BINS), 255, np.uint8)
            binned[known] = np.frombuffer(b"".join(b.column("bins").drop_null().to_pylist()), np.uint8).reshape(-1, BINS)
            full = (binned == 255).any(axis=1)
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for start, end in zip(edges, edges[1:], strict=False):
                x, y = (np.flatnonzero(side[start:end] == k) + start for k in (0, 1))
                if one := not len(y):
                    y = x
                for part in np.split(x, range(64, len(x), 64)):
                    i, j = np.nonzero((classes[part][:, None] != classes[y]) & (weight[part][:, None] <= top[y]) & (weight[y] <= top[part][:, None]))
                    i, j = part[i], y[j]
                    enough = least / (1 + least) * (weight[i] + weight[j]) * (1 - 1e-5) / unit  # rounding doesn't decide
                    ok = (np.minimum(binned[i], binned[j]).sum(axis=1) >= enough) | (full[i] & full[j])
                    i, j = ids[i[ok]], ids[j[ok]]
                    if one:
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        columns = [np.minimum(i, j), np.maximum(i, j), np.full(len(i), g[start])]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "g"])

    columns = ["g", "side", "id", "class", "weight", "top", "bins"]
    many = met.where("many").join(bins, "id").select(columns)
    few = met.where("not many").withColumn("bins", F.lit(None).cast("binary")).select(columns)
    found = many.unionByName(few).repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, g long")
    return found.groupBy("a", "b").agg(F.min("g").alias("g"))


def likely_in_reach(pairs: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """The pairs of ``within_reach`` that share a bucket and whose samples agree in ``least`` of all places, each once.

    Rows are (g, kind, id, pairs): kind 0 names a document of such pairs, kind 1 has the pairs, both sides' 64-bit ids.
    """
    for end in ("a", "b"):
        pairs = pairs.join(vertices.select(F.col("id").alias(end), F.col("bands").alias(f"bands_{end}"), F.col("samples").alias(f"s{end}")), end)
    pairs = pairs.where(F.arrays_overlap("bands_a", "bands_b")).select("g", "a", "b", "sa", "sb")
    pairs = pairs.repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(whole.column(c).to_pylist()), np.uint32).reshape(whole.num_rows, -1) for c in ("sa", "sb"))
            g, a, b = (whole.column(c).to_numpy()[(x == y).mean(axis=1) >= least] for c in ("g", "a", "b"))
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            out: list[tuple[int, int, int | None, bytes | None]] = []
            for start, end in zip(edges, edges[1:], strict=False):
                if start < end:
                    ends = np.stack((a[start:end], b[start:end]))
                    out += [(g[start], 0, int(n), None) for n in np.unique(ends)]
                    out.append((g[start], 1, None, ends.tobytes()))
            if out:
                cols = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["g", "kind", "id", "pairs"])

    return pairs.mapInArrow(run, "g long, kind int, id long, pairs binary")


def verified_in_blocks(likely: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs of ``likely_in_reach`` whose texts have at least this weighted Jaccard similarity: a, b, similarity.

    A text goes once to each g, and is cut into shingles once there.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf)
    named = likely.where("kind = 0").select("g", "kind", "id").distinct().withColumn("pairs", F.lit(None).cast("binary"))
    named = named.join(texts, "id").select("g", "kind", "pairs", "id", "text")
    rows = named.unionByName(likely.where("kind = 1").withColumn("text", F.lit(None).cast("string")))

    def compare(known: dict, pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if sum(len(others) for _, others in pairs) > 4:
            names, at = np.unique(np.concatenate([h for h, _ in known.values()]), return_inverse=True)
            cols = dict(zip(known, np.split(at, np.cumsum([len(h) for h, _ in known.values()])[:-1]), strict=True))
            row, sums = np.zeros(len(names)), {x: w.sum() for x, (_, w) in known.items()}
        else:
            cols = None
        for x, others in pairs:
            if cols is None:
                yield x, others, np.array([S.similarity(known[x], known[y]) for y in others.tolist()])
                continue
            row[cols[x]] = known[x][1]
            for k in range(0, len(others), 1024):
                part = others[k : k + 1024].tolist()
                both = np.minimum(row[np.concatenate([cols[y] for y in part])], np.concatenate([known[y][1] for y in part]))
                both = np.add.reduceat(both, np.cumsum([0] + [len(cols[y]) for y in part[:-1]]))
                found = both / (sums[x] + np.array([sums[y] for y in part]) - both)
                for i in np.flatnonzero(np.abs(found - least) < 1e-9):  # sums in another order don't decide
                    found[i] = S.similarity(known[x], known[part[i]])
                yield x, others[k : k + 1024], found
            row[cols[x]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known, pairs = None, {}, []

        def result() -> pa.RecordBatch:
            a, b, s = [], [], []
            for x, others, found in compare(known, pairs):
                ok = found >= least
                a.append(np.full(ok.sum(), x))
                b.append(others[ok])
                s.append(found[ok])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, s)], names=["a", "b", "similarity"])

        for whole in batches:
            for part in slices(iter([whole]), "text", S.CHUNK):
                h, times, sizes = S.shingled(part.column("text"))
                w, ends = S.weights(h, times, shared.value), sizes.cumsum()
                for g, kind, x, bs, end, n in zip(*(part.column(c).to_pylist() for c in ("g", "kind", "id", "pairs")), ends, sizes, strict=True):
                    if g != group:
                        if pairs:
                            yield result()
                        group, known, pairs = g, {}, []
                    if kind == 0:
                        known[x] = (h[end - n : end], w[end - n : end])
                    else:
                        a, b = np.frombuffer(bs, np.int64).reshape(2, -1)
                        order = np.argsort(a, kind="stable")
                        names, starts = np.unique(a[order], return_index=True)
                        pairs += zip(names.tolist(), np.split(b[order], starts[1:]), strict=True)
        if pairs:
            yield result()

    return rows.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, class) of each end of ``links`` (a, b): the smallest id that it is linked to, over any number of steps.

    Every vertex takes the smallest neighbour; links are then between the taken ones. Each round at least halves
    the vertices that still have links, so the rounds are few, and what is left of a round is stored.
    """
    edges, maps = stored(links.select("a", "b").where("a <> b"), "links"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("id"), "to"), "taken")
        maps.append(taken)
        ends = edges.join(taken.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(taken.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("class")).limit(0)
    found = maps[0].withColumnRenamed("to", "class")
    for m in maps[1:]:
        step = m.select(F.col("id").alias("class"), F.col("to").alias("next"))
        found = found.join(step, "class", "left").select("id", F.coalesce("next", "class").alias("class"))
    return stored(found, "classes")


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``classes`` (id, class) after new links between vertices, which join whole classes."""
    if classes is None:
        return components(links)
    ends = links.select("a", "b")
    for end in ("a", "b"):
        of = classes.select(F.col("id").alias(end), F.col("class").alias("c"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    step = components(ends)
    moved = classes.join(step.select(F.col("id").alias("class"), F.col("class").alias("to")), "class", "left")
    moved = moved.select("id", F.coalesce("to", "class").alias("class"))
    return stored(moved.unionByName(step.join(classes.select("id"), "id", "left_anti")), "classes")


def text_classes(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, content, salt), and their texts (content, first: smallest id, copies, class, n_links)."""
    spark = docs.sparkSession
    counts, n = frequencies(docs)
    idf = inverse(counts, n, settings.common)
    # Stored, so the salt of a row is fixed.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts(spark))).cast("int")
    sig = stored(signatures(docs, idf, settings).withColumn("salt", salt), "signatures")
    by_text = sig.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value(F.struct("bands", "samples", "size")).alias("s"))
    vertices = stored(by_text.select(F.monotonically_increasing_id().alias("id"), "content", "first", "copies", "s.*"), "vertices")

    rows = vertices.select("id", "size", F.posexplode("bands").alias("band", "key"))
    crowded = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("size") / BYTES)).alias("parts")).where("n > 1")
    members = rows.join(crowded, ["band", "key"])
    # Who shares its bands with many is near the middle of a group, and leads.
    central = members.groupBy("id").agg(F.sum("n").alias("central"))
    members = members.select("band", "key", "parts", "id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    members = stored(members.join(central, "id"), "members")
    # One plan at every size: the texts of candidates are shuffled once, whether or not their keys would fit a broadcast.
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    wanted = vertices.join(members.select("id").distinct(), "id", "left_semi").select("id", "content", F.coalesce(F.col("first").cast("string"), F.lit("")).alias("name"))
    texts = docs.select(content(F.col("text")).alias("content"), named, "text").join(wanted.hint("merge"), ["content", "name"])
    texts = stored(texts.dropDuplicates(["content", "name"]).select("id", "text"), "texts")

    # Each member and its bucket's leader.
    samples = vertices.select("id", "samples")
    lead = members.groupBy("band", "key").agg(F.max(F.struct("central", F.xxhash64("id", "band", "key").alias("h"), F.col("id").alias("b"))).alias("l"), F.max("parts").alias("parts"))
    lead = lead.select("band", "key", "parts", "l.b").join(samples.select(F.col("id").alias("b"), F.col("samples").alias("sb")), "b")
    lead = lead.select("band", "key", "b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = members.select("band", "key", "part", F.col("id").alias("a")).join(lead, ["band", "key", "part"]).where("a <> b")
    met = met.select("a", "b", "sb").join(samples.select(F.col("id").alias("a"), F.col("samples").alias("sa")), "a")
    likely = stored(agreeing(met.select("a", "b", "sa", "sb"), settings.agreement).distinct(), "likely")
    links = stored(verified_with_leaders(likely, texts, idf, settings.similarity), "verified")
    classes = merged(None, links)

    # All pairs of different classes in the buckets that have several, by the rare shingles that similar texts share.
    left = stored(members.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")), "members")
    several = left.groupBy("band", "key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.max("parts").alias("parts")).where("x <> y")
    several = several.select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = left.join(several, ["band", "key", "part"]).select("id", "class").distinct()
    rare = stored(rare_shingles(texts.join(left, "id"), idf, rarity(counts), settings.similarity), "rare")
    near = within_reach(meetings(rare), rare.where("bins is not null").select("id", "bins"), float(idf.max()), settings.similarity)
    likely = stored(likely_in_reach(near, vertices, settings.agreement), "likely")
    more = stored(verified_in_blocks(likely, texts, idf, settings.similarity), "verified")
    classes, links = merged(classes, more), links.unionByName(more)

    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    own = vertices.select("id", "content", "first", "copies").join(classes, "id", "left").join(ends, "id", "left")
    own = own.select("content", "first", "copies", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return sig.select("doc_id", "content", "salt"), stored(own, "own")


def near_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, class_id, class_size, n_links: the class of near-duplicates that the row belongs to.

    Texts are whole; words are cut at ASCII white space, ASCII case folds, shingles are five words (all words of a
    shorter text), weighed by TF-IDF. Rows of equal text are one vertex, whatever their ids. Two texts are linked if
    their weighted Jaccard similarity is at least ``settings.similarity``; a class is what links join, its id the
    smallest doc_id. ``n_links`` counts the verified links of the row's text to other texts: enough of them to join
    the class are made, not every pair of it.

    Candidates come from equal bands of samples. First each member of a bucket is compared with the bucket's leader,
    the member that shares its bands with the most others and so is near the middle of a group: this is linear in
    the bucket's size and joins up thousands of near copies at once. Then every pair of a bucket that is of two
    classes still is compared, in buckets of all sizes: a class ends only where all its pairs with other classes are
    decided. Similarity is not transitive, so nobody stands for its class: a bucket is done only when all its members
    are of one. Comparing starts with samples; texts of the remaining pairs are verified, in the last step by blocks,
    each text cut into shingles once a block. What stands under one key (a bucket, a leader) is salted; the two
    look-ups of narrow rows, by bucket and by class, are sort-merge joins whose large partitions adaptive execution
    splits.

    Null text counts as empty. Texts without words are alike only to each other. Null ids are compared like others;
    a class that only has rows with null ids has class_id null. Rows that repeat, also an id with several texts, are
    each of the class of their own text. An empty table gives no rows. Columns other than doc_id and text are not
    looked at, whatever they are called.
    """
    sig, own = text_classes(docs, settings)
    of_class = own.groupBy("class").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    own = own.join(of_class, "class").select("content", "class_id", "class_size", "n_links")
    # A text that many rows have is looked up by each of its salts.
    own = sig.select("content", "salt").distinct().join(own, "content")
    return sig.join(own, ["content", "salt"]).select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class of near-duplicates, as ``near_classes`` has them; columns as in ``docs``.

    The row with the smallest id stays, of equal ids that whose text's hash is smallest, a null id only where the
    class has no other; of rows that repeat both id and text one stays. Rows are told apart by text, so a text that
    is like no other stays whatever else its id stands for. Empty and null texts are one class, an empty table gives
    no rows. Extra columns are carried along, whatever they are called. Rows of one text are dealt over salts by id, and rows that
    repeat both are combined before they are shuffled, so a text that a third of all rows have is spread.
    """
    sig, own = text_classes(docs, settings)
    keeper = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("content"))).alias("k")
    marked = own.join(own.groupBy("class").agg(keeper), "class").withColumn("gone", F.col("content") != F.col("k.content"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marked = marked.where("gone or copies > 1").select("content", "gone", name("first").alias("keep"))
    # A text that many rows have is looked up by each of its salts; what is known of it goes to those that there are.
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(salts(docs.sparkSession))).cast("int").alias("salt")
    marked = sig.select("content", spread).distinct().join(marked, "content")
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), content(F.col("text")).alias("content"), spread, name("doc_id").alias("name"))
    rows = rows.join(marked, ["content", "salt"], "left").where("keep is null or not gone and keep = name")
    single, several = rows.where("keep is null"), rows.where("keep is not null").dropDuplicates(["content", "name"])
    return single.select("row.*").unionByName(several.select("row.*"))
