"""Classification metrics as weighted sums, so that replicates and groups are grouping keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

BLOCK = 4 << 20  # bytes of a block's vectors
CELLS = 1 << 20  # distances that are worked out at once


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def confusion(df: DataFrame, label: str, pred: str, weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """(by..., tn, fp, fn, tp) of 0/1 labels and predictions."""
    w = _w(weight)
    cell = lambda y, p: F.sum(F.when((F.col(label) == y) & (F.col(pred) == p), w).otherwise(0))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def rates(confused: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and mcc; null where a denominator is 0, except mcc, which is 0 then."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confused.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)),
        }
    )


def class_report(confused: DataFrame) -> DataFrame:
    """(by..., label, precision, recall, f1, support) for both classes."""
    keys = [c for c in confused.columns if c not in ("tn", "fp", "fn", "tp")]
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("label"), tp.alias("hit"), fp.alias("false"), fn.alias("missed")), F.struct(F.lit(0).alias("label"), tn.alias("hit"), fn.alias("false"), fp.alias("missed"))))
    x = confused.select(*keys, both.alias("c")).select(*keys, "c.*")
    return x.select(
        *keys, "label", F.try_divide("hit", F.col("hit") + F.col("false")).alias("precision"), F.try_divide("hit", F.col("hit") + F.col("missed")).alias("recall"),
        F.try_divide(2 * F.col("hit"), 2 * F.col("hit") + F.col("false") + F.col("missed")).alias("f1"), (F.col("hit") + F.col("missed")).alias("support"),
    )


def curve(df: DataFrame, label: str, score: str, weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """(by..., score, pos, neg, tp, fp, all_pos, all_neg): totals at and above each distinct score.

    Rows are summed by score first. Distinct scores are dealt to ranges of equally many, however close to each other
    they are; running sums are taken within a range and start from the sums of the group's ranges above.
    """
    by, w = list(by), _w(weight)
    x = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("double").alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).cast("double").alias("neg"))
    # Stored, so that both uses see the same ranges. Scores fall from range to range.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = stored(x.repartitionByRange(ranges, *by, F.desc("score")).withColumn("__range", F.spark_partition_id()), "curve")
    sums = x.groupBy(*by, "__range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("p").over(above), zero).alias("__p"), F.coalesce(F.sum("n").over(above), zero).alias("__n"), F.sum("p").over(every).alias("all_pos"), F.sum("n").over(every).alias("all_neg"))
    upto = Window.partitionBy(*by, "__range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("tp", F.sum("pos").over(upto)).withColumn("fp", F.sum("neg").over(upto))
    x = x.join(sums, [*by, "__range"])
    return x.select(*by, "score", "pos", "neg", (F.col("tp") + F.col("__p")).alias("tp"), (F.col("fp") + F.col("__n")).alias("fp"), "all_pos", "all_neg")


def _precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def areas(curves: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """(by..., pr_auc, average_precision, roc_auc) of ``curve``'s rows.

    ``pr_auc`` is the trapezoid area from the point (0, 1); ``average_precision`` the sum of recall steps times
    precision; ``roc_auc`` the trapezoid area. Null for a group without positives (roc: or negatives).
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    step = F.try_divide(pos, F.col("all_pos"))
    here, before = _precision(tp, fp), _precision(tp - pos, fp - neg)
    wide, high = F.try_divide(neg, F.col("all_neg")), F.try_divide(2 * tp - pos, 2 * F.col("all_pos"))
    return curves.groupBy(*by).agg(F.sum(step * (here + before) / 2).alias("pr_auc"), F.sum(step * here).alias("average_precision"), F.sum(wide * high).alias("roc_auc"))


def r2(df: DataFrame, y: str, p: str, by: Iterable[str] = ()) -> DataFrame:
    """1 - residual / total sum of squares, in one pass."""
    e = F.sum(F.pow(F.col(y) - F.col(p), 2))
    return df.groupBy(*by).agg((1 - F.try_divide(e, F.var_pop(y) * F.count(y))).alias("r2"))


def percentile_ci(df: DataFrame, cols: Iterable[str], by: Iterable[str] = (), level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of each metric over replicates; replicates without it don't count."""
    a = (1 - level) / 2
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(a)).alias(f"{c}_low"), F.percentile(c, F.lit(1 - a)).alias(f"{c}_high")]
    return df.groupBy(*by).agg(*out)


def group_attribution(df: DataFrame, groups: dict[str, str], weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Mean absolute value of each group's summed attributions; ``groups`` names array columns."""
    w = _w(weight)
    total = lambda c: F.abs(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")))
    return df.groupBy(*by).agg(*[F.try_divide(F.sum(total(c) * w), F.sum(w)).alias(g) for g, c in groups.items()])


def _label_blocks(x: DataFrame, size: int) -> DataFrame:
    """(block, ids, labels, vs): up to ``size`` rows of (id, label, v) in order of their labels, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        made = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal made
            b = pa.concat_batches(kept)
            kept.clear()
            made += 1
            packed = [b.column("id").to_numpy().tobytes(), b.column("label").to_numpy().tobytes(), b.column("v").flatten().to_numpy(zero_copy_only=False).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([made]), *[pa.array([p], pa.binary()) for p in packed]], names=["block", "ids", "labels", "vs"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, at + size - sum(k.num_rows for k in kept))
                kept.append(b.slice(at, to - at))
                at = to
                if sum(k.num_rows for k in kept) == size:
                    yield block()
        if kept:
            yield block()

    return x.mapInArrow(run, "block long, ids binary, labels binary, vs binary")


def silhouette(df: DataFrame, array: str = "px", label: str = "label", key: str = "id", block: int | None = None) -> DataFrame:
    """(n, silhouette): mean silhouette of a labelling by Euclidean distance, exact.

    Rows go in blocks of ``block`` at most (as many as give all cores several pairs of blocks, within ``BLOCK`` bytes),
    in order of labels. Each pair of blocks is worked on once, for both sides, some rows at a time, so a task holds two
    blocks and bounded squares of distances; these are summed up by (row, label) inside the pair, so what is shuffled is
    blocks and one sum for each. All distances are in the definition, so work grows with the square of the rows;
    ``simplified_silhouette`` grows with the rows only. A row without a label or vector counts 0, and with no other.
    """
    n = df.count()
    kind = df.schema[array].dataType.elementType.simpleString()
    number = np.dtype("float32" if kind == "float" else "float64")
    x = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(array).cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    x = x.where(F.col("label").isNotNull() & F.col("v").isNotNull())
    width = (x.select(F.size("v").alias("d")).first() or {"d": 1})["d"]
    cores = df.sparkSession.sparkContext.defaultParallelism
    block = block or max(1, min(BLOCK // (number.itemsize * max(width, 1)), max(256, -(-n // (2 * cores)))))
    blocks = stored(_label_blocks(x.repartitionByRange(max(1, -(-n // block)), "label", "id").sortWithinPartitions("label", "id"), block), "blocks")

    def sums(pair: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in pair.select(["side", "ids", "labels", "vs"]).to_pylist()}
        same = 1 not in sides
        sides = [sides[0], sides.get(1, sides[0])]
        ids, labels = ([np.frombuffer(r[c], t) for r in sides] for c, t in (("ids", np.int64), ("labels", np.int32)))
        a, b = (np.frombuffer(r["vs"], number).astype(np.float64).reshape(len(i), -1) for r, i in zip(sides, ids, strict=True))
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        firsts = [np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1)) for x in labels]
        of_a, of_b = np.zeros((len(a), len(firsts[1]))), np.zeros((len(firsts[0]), len(b)))
        step = max(1, CELLS // len(b))
        for start, stop in zip(firsts[0], [*firsts[0][1:], len(a)], strict=True):
            nth = int(np.searchsorted(firsts[0], start))
            for at in range(start, stop, step):
                some = slice(at, min(stop, at + step))
                norms = a2[some, None] + b2[None, :]
                s = norms - 2 * a[some] @ b.T
                i, j = np.nonzero(s <= 1e-5 * norms)  # products have few right digits there
                for k in range(0, len(i), CELLS // 16):
                    s[i[k : k + CELLS // 16], j[k : k + CELLS // 16]] = ((a[some][i[k : k + CELLS // 16]] - b[j[k : k + CELLS // 16]]) ** 2).sum(1)
                np.sqrt(s, out=s)
                of_a[some] = np.add.reduceat(s, firsts[1], axis=1)
                of_b[nth] += s.sum(axis=0)
        parts = []
        for own, s, other in ((0, of_a, 1), (1, of_b.T, 0))[: 1 if same else 2]:
            sizes = np.diff([*firsts[other], len(ids[other])])
            m = len(sizes)
            parts.append((np.repeat(ids[own], m), np.repeat(labels[own], m), np.tile(labels[other][firsts[other]], len(ids[own])), s.reshape(-1), np.tile(sizes, len(ids[own]))))
        return pa.table(dict(zip(("id", "own", "other", "s", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    names = blocks.select("block")
    pairs = names.select(F.col("block").alias("q")).crossJoin(names.select(F.col("block").alias("p"))).where("q <= p")
    one = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("block"))
    both = F.explode(F.when(F.col("q") == F.col("p"), F.array(one(0, "q"))).otherwise(F.array(one(0, "q"), one(1, "p"))))
    met = pairs.select("q", "p", both.alias("x")).select("q", "p", "x.side", "x.block").join(blocks, "block")
    d = met.groupBy("q", "p").applyInArrow(sums, "id long, own int, other int, s double, n long").groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    p = d.groupBy("id", "own").agg(
        F.max(F.when(F.col("own") == F.col("other"), F.try_divide("s", F.col("n") - 1))).alias("a"), F.max(F.when(F.col("own") == F.col("other"), F.col("n"))).alias("size"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("size") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    told = p.select(s.alias("s")).unionByName(df.where(F.col(label).isNull() | F.col(array).isNull()).select(F.lit(0.0).alias("s")))
    return told.agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))


def simplified_silhouette(df: DataFrame, array: str = "px", label: str = "label") -> DataFrame:
    """(label, n, silhouette): means by label of (b - a) / max(a, b), with a a row's distance to its label's centre and b
    that to the nearest other centre; 0 if both are 0, null if there is one label only.

    One pass over the rows. Labels are few, their centres go to the driver.
    """
    x = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(array).cast("array<double>").alias("v"))
    means = x.select("label", F.posexplode("v").alias("i", "p")).groupBy("label", "i").agg(F.avg("p").alias("p"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("c")).collect()
    if not centres:
        return x.select("label", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("silhouette")).limit(0)
    d = lambda c: F.sqrt(F.aggregate(F.zip_with("v", F.lit(c), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p))
    far = F.array(*[F.struct(F.lit(r["label"]).alias("l"), d(r["c"]).alias("d")) for r in centres])
    x = x.withColumn("far", far)
    a = F.array_max(F.transform(F.filter("far", lambda f: f["l"] == F.col("label")), lambda f: f["d"]))
    b = F.array_min(F.transform(F.filter("far", lambda f: f["l"] != F.col("label")), lambda f: f["d"]))
    x = x.select("label", a.alias("a"), b.alias("b"))
    s = F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))
