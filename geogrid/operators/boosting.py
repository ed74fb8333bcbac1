"""Boosted trees of many fits at once: each level of all fits' trees is one scan of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

CELLS = 1 << 19  # (row, fit) pairs that are worked on at once
FITS = 20  # fits whose sums travel together
ROWS = 20_000  # rows of a task, where all cores have some: sums are as large for few rows as for many


@dataclass(frozen=True)
class Settings:
    """Trees of ``depth`` levels, each weighed by ``rate``; ``penalty`` is added to a leaf's second derivative, which is
    ``least`` at least. Features are cut into ``bins`` by quantiles of all rows."""

    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    penalty: float = 1.0
    least: float = 1.0
    bins: int = 32


@dataclass
class Forest:
    """Trees of fits: whole binary trees, node k's children are 2 k + 1 and 2 k + 2; a row goes left if its feature is
    at most the threshold. ``feature`` and ``threshold`` are (fits, trees, nodes), ``value`` (fits, trees, leaves)."""

    base: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    squared: np.ndarray
    #: Sums of weights, and of weighted labels, that each fit has learnt from.
    weights: np.ndarray
    labels: np.ndarray
    #: Where thresholds are of standardised features: means and deviations (fits, features).
    means: np.ndarray | None = None
    stds: np.ndarray | None = None

    def margins(self, v: np.ndarray) -> np.ndarray:
        """(rows, fits): log-odds, or the value itself of squared loss."""
        out = np.repeat(self.base[None, :], len(v), axis=0)
        row = np.arange(len(v))[:, None]
        each = np.arange(out.shape[1])[None, :]
        for t in range(self.feature.shape[1]):
            k = np.zeros(out.shape, np.int64)
            for _ in range(int(np.log2(self.value.shape[2]))):
                j = self.feature[each, t, k]
                x = v[row, j] if self.means is None else (v[row, j] - self.means[each, j]) / self.stds[each, j]
                k = 2 * k + 1 + ~(x <= self.threshold[each, t, k])
            out += self.value[each, t, k - self.feature.shape[2]]
        return out

    def nodes(self, v: np.ndarray, row: np.ndarray, each: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node that each pair of a row and a fit reaches in a tree after some levels."""
        width = self.feature.shape[2]
        feature, threshold, k = self.feature[:, tree].reshape(-1), self.threshold[:, tree].reshape(-1), np.zeros(len(row), np.int64)
        for _ in range(levels):
            at = each * width + k
            k = 2 * k + 1 + ~(v[row, feature[at]] <= threshold[at])
        return k

    def pair_scores(self, v: np.ndarray, row: np.ndarray, each: np.ndarray) -> np.ndarray:
        """``scores`` of some pairs of a row and a fit only; not for standardised features."""
        m, first = self.base[each], self.feature.shape[2]
        for t in range(self.feature.shape[1]):
            m += self.value[each, t, self.nodes(v, row, each, t, int(np.log2(self.value.shape[2]))) - first]
        return np.where(self.squared[each], m, 1 / (1 + np.exp(-np.clip(m, -500, 500))))

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Probabilities of logistic fits, values of the others."""
        m = self.margins(v)
        return np.where(self.squared[None, :], m, 1 / (1 + np.exp(-np.clip(m, -500, 500))))


@dataclass
class Fits:
    """What is fitted: ``n`` fits for each group of rows.

    Rows are (g, id, v, y, w): group, key, features, labels (one for all fits, or one for each), and weights: with
    ``packed`` bits in longs, else a number for each. ``lanes`` tells for each fit which bit or number is its own, so
    that fits can share one. ``allowed`` (fits, features) tells which features a fit may use, ``squared`` which fits
    have squared loss; the others are logistic. Rows with label 1 weigh ``positive`` times as much in each fit.
    """

    n: int
    allowed: np.ndarray
    lanes: np.ndarray | None = None
    packed: bool = False
    squared: np.ndarray | None = None
    positive: np.ndarray | None = None
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        self.lanes = np.arange(self.n) if self.lanes is None else np.asarray(self.lanes)
        self.squared = np.zeros(self.n, bool) if self.squared is None else np.asarray(self.squared)
        self.positive = np.ones(self.n) if self.positive is None else np.asarray(self.positive, np.float64)

    def read(self, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, v, row, fit, y, w) of some rows of one group at a time: ``v`` of all of them, and of each pair of a row
        and a fit that it has a weight in the row's number, the fit, the label and the weight. Pairs without are left out."""
        g = b.column("g").to_numpy()
        v, y, w = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1) for c in ("v", "y", "w"))
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        step = max(1, CELLS // self.n)
        for start, stop in zip(cuts, cuts[1:], strict=False):
            for at in range(start, stop, step):
                some = slice(at, min(stop, at + step))
                weights = (unpacked(w[some]) if self.packed else w[some])[:, self.lanes]
                row, each = np.divmod(np.flatnonzero(weights > 0), self.n)
                labels = y[some][row, each] if y.shape[1] > 1 else y[some][row, 0]
                weights = weights[row, each].astype(np.float64)
                weights *= np.where(~self.squared[each] & (labels == 1), self.positive[each], 1)
                yield int(g[start]), v[some], row, each, labels, weights


def unpacked(longs: np.ndarray) -> np.ndarray:
    """The bits of rows of longs, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(longs).view(np.uint8), axis=1, bitorder="little")


def summed(rows: DataFrame, made, shape: tuple[int, ...], fits: int, finish=None) -> dict[int, np.ndarray]:  # noqa: ANN001
    """Sums (fits, *shape) by group of what ``made(batch)`` yields as (group, sums); ``finish`` maps the sums of some
    fits, (first fit, sums), where they have been added up, to what goes to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out(g: int) -> Iterator[pa.RecordBatch]:
            sums = total.pop(g)
            for i in range(0, fits, FITS):
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([i]), pa.array([sums[i : i + FITS].tobytes()])], names=["g", "i", "sums"])

        for b in batches:
            if b.num_rows:
                for g, sums in made(b):
                    if g not in total:
                        for old in list(total):  # rows come in order of groups
                            yield from out(old)
                        total[g] = np.zeros((fits, *shape))
                    total[g] += sums
        for g in list(total):
            yield from out(g)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for g, i, sums in zip(*(b.column(c).to_pylist() for c in ("g", "i", "sums")), strict=True):
                this = np.frombuffer(sums)
                total[g, i] = total[g, i] + this if (g, i) in total else this
        for (g, i), sums in total.items():
            sums = sums.reshape(-1, *shape)
            sums = finish(g, i, sums) if finish else sums
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([i]), pa.array([sums.tobytes()])], names=["g", "i", "sums"])

    schema = "g long, i long, sums binary"
    parts: dict[int, list] = {}
    for r in rows.mapInArrow(each, schema).repartition("g", "i").mapInArrow(add, schema).collect():
        parts.setdefault(r["g"], []).append((r["i"], np.frombuffer(r["sums"])))
    return {g: np.concatenate([x.reshape(min(FITS, fits - i), -1) for i, x in sorted(p, key=lambda x: x[0])]) for g, p in parts.items()}


def edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Cuts of each feature at its quantiles."""
    q = F.percentile_approx("x", F.lit([(k + 1) / bins for k in range(bins - 1)]), 10_000)
    x = rows.select(F.posexplode("v").alias("dim", "x")).where("not isnan(x)").groupBy("dim").agg(q.alias("q"))
    return [np.unique(np.array(r["q"], np.float64)) for r in x.orderBy("dim").collect()]


def best_splits(sums: np.ndarray, allowed: np.ndarray, s: Settings) -> np.ndarray:
    """(fits, nodes, 6): feature, bin, and the sums (first and second derivatives) left and right of the best split of
    ``sums`` (fits, nodes, features, bins, 2). A node without a split has bin -1 and all its sums left."""
    left = sums.cumsum(axis=3)
    all_ = left[:, :, :, -1:]
    right = all_ - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.penalty)
    gain = worth(left) + worth(right) - worth(all_)
    gain[(left[..., 1] < s.least) | (right[..., 1] < s.least)] = -np.inf
    gain[np.broadcast_to(~allowed[:, None, :, None], gain.shape)] = -np.inf
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    found = np.take_along_axis(flat, best[:, :, None], 2)[:, :, 0] > 1e-9
    feature, cut = best // gain.shape[3], best % gain.shape[3]
    i, k = np.indices(best.shape)
    out = np.empty((*best.shape, 6))
    out[..., 0], out[..., 1] = np.where(found, feature, 0), np.where(found, cut, -1)
    out[..., 2:4] = np.where(found[..., None], left[i, k, feature, cut], all_[:, :, 0, 0])
    out[..., 4:6] = np.where(found[..., None], right[i, k, feature, cut], 0)
    return out


def fit(rows: DataFrame, fits: Fits) -> dict[int, Forest]:
    """The forest of each group; gradient boosting by second-order gains on binned features, as usual for such trees.

    Each level of the trees of all fits and groups is one scan: a task sums derivatives by (fit, node, feature, bin)
    of its rows, the sums of some fits at a time are added up and their best splits chosen where they meet, and only
    splits go to the driver. What the rows have reached is worked out from the trees in each scan, for the fits only that
    a row has a weight in, so no state is kept between scans, and a lost executor costs its tasks only. Each fit reads its own weight of a row, nothing is
    copied for it. Sums are as large for few rows as for many, so small tables have few tasks.

    Missing features (NaN) go right where there is a split. A group or fit without rows, or with one label only, has trees without splits.
    """
    s, n = fits.settings, fits.n
    rows = rows.select("g", "id", "v", "y", "w")
    cuts = edges(rows, s.bins)
    d, width = len(cuts), s.bins
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = rows.count()
    parts = max(1, min(cores * 64, max(min(cores * 2, total // 250), total // ROWS)))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                out = np.stack([np.searchsorted(cuts[j], v[:, j]) for j in range(d)], axis=1).astype(np.int16)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * d, pa.int32()), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("g"), listed, b.column("y"), b.column("w")], names=["g", "v", "y", "w"])

    kind = rows.schema["w"].dataType.simpleString()
    slim = rows.repartitionByRange(parts, "g", "id").sortWithinPartitions("g", "id").mapInArrow(binned, f"g int, v array<smallint>, y array<double>, w {kind}")
    slim = stored(slim, "binned")

    def first(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for g, _, _, each, y, w in fits.read(b):
            yield g, np.stack((np.bincount(each, w, n), np.bincount(each, w * y, n)), axis=1)

    start = summed(slim, first, (2,), n)
    forests: dict[int, Forest] = {}
    nodes = 2**s.depth - 1
    for g, x in start.items():
        mean = np.divide(x[:, 1], x[:, 0], out=np.full(n, 0.5), where=x[:, 0] > 0)
        odds = np.clip(mean, 1e-6, 1 - 1e-6)
        base = np.where(fits.squared, mean, np.log(odds / (1 - odds)))
        forests[g] = Forest(base, np.zeros((n, s.rounds, nodes), np.int32), np.full((n, s.rounds, nodes), np.inf), np.zeros((n, s.rounds, nodes + 1)), fits.squared, x[:, 0], x[:, 1])
    for t in range(s.rounds):
        for level in range(s.depth):
            _level(slim, fits, forests, cuts, t, level, d, width)
    for f in forests.values():  # from bins to values
        k = f.threshold.astype(np.float64)
        whole = np.isinf(k)
        value = np.zeros_like(k)
        for j, c in enumerate(cuts):
            at = ~whole & (f.feature == j)
            value[at] = c[k[at].astype(int)]
        f.threshold = np.where(whole, np.inf, value)
    return forests


def _level(slim: DataFrame, fits: Fits, forests: dict[int, Forest], cuts: list[np.ndarray], t: int, level: int, d: int, width: int) -> None:
    """One level of tree ``t`` of all forests, whose thresholds are numbers of bins as yet."""
    s, n, first, count = fits.settings, fits.n, 2**level - 1, 2**level
    shared = slim.sparkSession.sparkContext.broadcast(forests)
    parts = count * d * width

    def made(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for g, v, row, each, y, w in fits.read(b):
            forest = shared.value[g]
            m = forest.base[each]
            for tree in range(t):
                m += forest.value[each, tree, forest.nodes(v, row, each, tree, s.depth) - forest.feature.shape[2]]
            k = forest.nodes(v, row, each, t, level)
            p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            squared = fits.squared[each]
            slope = w * np.where(squared, y - m, y - p)
            bend = w * np.where(squared, 1.0, p * (1 - p))
            base = (each * count + (k - first)) * width
            out = np.zeros((n, count, d, width, 2))
            for j in range(d):
                key = base + v[row, j]
                for i, x in enumerate((slope, bend)):
                    out[:, :, j, :, i] = np.bincount(key, x, n * count * width).reshape(n, count, width)
            yield g, out.reshape(n, parts, 2)

    def finish(_: int, i: int, sums: np.ndarray) -> np.ndarray:
        return best_splits(sums.reshape(len(sums), count, d, width, 2), fits.allowed[i : i + len(sums)], s)

    for g, found in summed(slim, made, (parts, 2), n, finish).items():
        found, f = found.reshape(n, count, 6), forests[g]
        f.feature[:, t, first : first + count] = found[..., 0]
        f.threshold[:, t, first : first + count] = np.where(found[..., 1] < 0, np.inf, found[..., 1])
        if level == s.depth - 1:
            leaf = lambda x: s.rate * x[..., 0] / (x[..., 1] + s.penalty)
            left = leaf(found[..., 2:4])
            f.value[:, t, 0::2], f.value[:, t, 1::2] = left, np.where(found[..., 1] < 0, left, leaf(found[..., 4:6]))
    shared.destroy()


def score(rows: DataFrame, forests: dict[int, Forest], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(g, *keep, fit, score) for each row (g, v, ...) and each fit of its group."""
    return score_arrays(rows, forests, keep).select("g", *keep, F.posexplode("scores").alias("fit", "score"))


def score_arrays(rows: DataFrame, forests: dict[int, Forest], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(g, *keep, scores) for each row, a score for each fit of its group, by one scan for all fits.

    The forests go to all tasks; ``ModelStore`` bounds how many do at once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                forest = shared.value.get(int(g[start]))
                step = max(1, CELLS // len(forest.base)) if forest else 1
                for at in range(start, stop, step) if forest else ():
                    found = forest.scores(v[at : min(stop, at + step)])
                    ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("g").slice(at, len(found)), *[b.column(c).slice(at, len(found)) for c in keep], pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], names=["g", *keep, "scores"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("g", *keep, "v").mapInArrow(run, f"g int, {kinds}, scores array<double>")


def score_asked(rows: DataFrame, forests: dict[int, Forest], asked: str, lanes: np.ndarray, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(g, *keep, fit, score) for each row and those fits of its group alone whose bit of ``asked``, longs, is set;
    ``lanes`` tells each fit's bit. By one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("g").to_numpy()
            v, bits = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1) for c in ("v", asked))
            order = np.argsort(g, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(g[order])) + 1).tolist(), len(g)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                forest = shared.value.get(int(g[order[start]]))
                step = max(1, CELLS // len(lanes))
                for at in range(start, stop, step) if forest else ():
                    some = order[at : min(stop, at + step)]
                    row, each = np.divmod(np.flatnonzero(unpacked(bits[some])[:, lanes]), len(lanes))
                    found = forest.pair_scores(v[some], row, each)
                    from_ = pa.array(some[row])
                    yield pa.RecordBatch.from_arrays([b.column("g").take(from_), *[b.column(c).take(from_) for c in keep], pa.array(each, pa.int32()), pa.array(found)], names=["g", *keep, "fit", "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("g", *dict.fromkeys([*keep, asked]), "v").mapInArrow(run, f"g int, {kinds}, fit int, score double")
