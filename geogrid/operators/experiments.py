"""The window experiment: many repeats of splitting, drawing, fitting and scoring, as bits of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniforms
from . import boosting, metrics, timeline
from .storage import stored


ROWS = 1 << 16  # rows whose numbers are drawn together


def bit(x: str | Column, r: Column) -> Column:
    """Whether bit ``r`` of an array of longs is set."""
    r = r.cast("int")
    long = F.get(x, F.call_function("div", r, F.lit(64)).cast("int"))
    return F.call_function("shiftright", long, F.pmod(r, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _packed(bits: np.ndarray) -> pa.Array:
    """Rows of bits, a multiple of 64 each, as arrays of longs, the lowest bit first."""
    longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(longs) + 1) * longs.shape[1], pa.int32()), pa.array(longs.reshape(-1)))


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    longs = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.unpackbits(np.ascontiguousarray(longs).view(np.uint8), axis=1, bitorder="little").astype(bool)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``ROWS`` rows, but for the last."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(k.num_rows for k in kept) >= ROWS:
            yield pa.concat_batches(kept)
            kept = []
    if kept and (b := pa.concat_batches(kept)).num_rows:
        yield b


def membership(rows: DataFrame, repeats: int, test: float = 0.2, ratio: float = 0.1, window: str = "start", key: str = "id", group: str = "city_id", label: str = "label") -> DataFrame:
    """Adds ``train`` and ``tested``: in which repeats a row of a window is fitted on, and in which it is scored.

    Bit r is of repeat r. In each repeat int(n * test) of the n groups that have a positive row in the window are drawn
    for the test, and all of their rows with them; rows of no group (-1) are drawn one by one. Of both parts all
    positives stay, and so many negatives that there are positives / ratio, by a chance from a hash of window, repeat
    and key. Rows are not copied for repeats; only groups are ranked and labels are counted repeat by repeat. A row's
    numbers of all repeats are drawn in batches; rows are dealt over all tasks for it, however few files they are from.
    """
    width = -(-repeats // 64)
    middles = [f"{r}_" for r in range(repeats)]
    head = lambda salt: F.concat(F.lit(salt), F.col(window).cast("string"), F.lit("_"))
    some = rows.where((F.col(label) == 1) & (F.col(group) > -1)).select(window, group).distinct()
    each = some.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy(window, "r").orderBy(uniform(F.concat(head("group"), F.col("r").cast("string"), F.lit("_")), group), group)
    every = Window.partitionBy(window, "r")
    drawn = each.withColumn("nth", F.row_number().over(order)).withColumn("n", F.count("*").over(every)).where(F.col("nth") <= F.floor(F.col("n") * test))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("r", F.lit(64)).cast("int"))
    of_group = drawn.groupBy(window, group).agg(F.array(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("r") / 64) == k, one)), F.lit(0).cast("long")) for k in range(width)]).alias("__drawn"))
    none = F.array_repeat(F.lit(0).cast("long"), width)
    x = rows.join(of_group, [window, group], "left")
    x = x.withColumn("__alone", ~F.coalesce(F.col(group) > -1, F.lit(False))).withColumn("part", F.when(F.col("__alone"), none).otherwise(F.coalesce("__drawn", none))).drop("__drawn")
    x = x.withColumn("__head", head("row")).withColumn("__tail", F.col(key).cast("string"))
    columns = rows.columns

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            part = _unpacked(b.column("part"), b.num_rows)
            alone = np.flatnonzero(b.column("__alone").to_numpy(zero_copy_only=False))
            for i, r, u in uniforms(b.column("__head").take(pa.array(alone)), middles, b.column("__tail").take(pa.array(alone))):
                part[alone[i], r] = u < test
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], _packed(part)], names=[*columns, "part"])

    kinds = lambda df, *more: ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"{c} array<bigint>" for c in more]])
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = stored(x.repartition(tasks, window, key).mapInArrow(parted, kinds(rows, "part")), "parts")

    r = F.sequence(F.lit(0), F.lit(repeats - 1))
    counts = x.select(window, label, "part", F.explode(r).alias("r")).select(window, "r", bit("part", F.col("r")).alias("test"), (F.col(label) == 1).alias("y"))
    counts = counts.groupBy(window, "r", "test").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    chance = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.floor(F.col("pos") / ratio), "neg"), F.lit(0.0)))
    chances: dict = {}  # two numbers a window and repeat
    for c in counts.select(window, "r", "test", chance.alias("c")).collect():
        chances.setdefault(c[window], np.zeros((2, repeats)))[int(c["test"]), c["r"]] = c["c"]

    def stayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            part = _unpacked(b.column("part"), b.num_rows)
            positive = b.column("__positive").to_numpy(zero_copy_only=False)
            stay = np.zeros(part.shape, bool)
            stay[positive, :repeats] = True
            others = np.flatnonzero(~positive)
            starts, which = np.unique(b.column(window).to_numpy(zero_copy_only=False)[others], return_inverse=True)
            rates = np.array([chances[s] for s in starts.tolist()]).reshape(-1, 2, repeats)
            for i, r, u in uniforms(b.column("__head").take(pa.array(others)), middles, b.column("__tail").take(pa.array(others))):
                stay[others[i], r] = u < rates[which[i], part[others[i], r].astype(int), r]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], _packed(part & stay), _packed(~part & stay)], names=[*columns, "tested", "train"])

    x = x.withColumn("__positive", F.coalesce(F.col(label) == 1, F.lit(False))).withColumn("__head", head("draw")).withColumn("__tail", F.col(key).cast("string"))
    return x.mapInArrow(stayed, kinds(rows, "tested", "train"))


def in_windows(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """The eligible cells of each window [start, end), labelled as of the window; see ``timeline.eligible``.

    Windows are as many as steps in the range of years; they travel as a literal.
    """
    w = [(r["start"], r["end"]) for r in windows.select("start", "end").orderBy("start").collect()]
    if not w:
        return cells.withColumn("start", F.lit(0)).withColumn("end", F.lit(0)).withColumn("label", F.lit(0)).limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in w]))
    x = cells.withColumn("__w", each).select("*", "__w.start", "__w.end").drop("__w")
    x = timeline.eligible(x, F.col("start"), F.col("end"))
    return x.withColumn("label", F.coalesce("is_city", F.lit(0)))


def window_experiment(rows: DataFrame, features: list[str], towns: list[str], repeats: int = 80, settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """(start, iteration, has_2nd_nature, pr_auc, f1, mcc, positives) of each window, repeat, and with and without the
    features ``towns``.

    ``rows`` are (start, id, label, train, tested, *features, *towns), see ``membership``. All windows, repeats and
    both variants are fitted together: one scan a level, a fit reads its repeat's bit of a row. Both variants of a
    repeat have the same rows. Only those pairs of a row and a fit are worked on that the bits name.
    """
    every = [*features, *towns]
    x = rows.select(F.col("start").cast("int").alias("g"), "id", F.array(*[F.col(c).cast("double") for c in every]).alias("v"), F.array(F.col("label").cast("double")).alias("y"), F.col("train").alias("w"), "tested")
    x = stored(x, "experiment")
    allowed = np.ones((2 * repeats, len(every)), bool)
    allowed[repeats:, len(features) :] = False
    lanes = np.tile(np.arange(repeats), 2)
    forests = boosting.fit(x, boosting.Fits(2 * repeats, allowed, lanes, packed=True, settings=settings))
    p = boosting.score_asked(x, forests, "tested", lanes, keep=("y",)).select("g", F.get("y", F.lit(0)).cast("int").alias("label"), "fit", "score")
    p = stored(p.withColumn("pred", (F.col("score") > 0.5).cast("int")), "scored")
    by = ["g", "fit"]
    r = metrics.rates(metrics.confusion(p, "label", "pred", by=by)).join(metrics.areas(metrics.curve(p, "label", "score", by=by), by), by)
    return r.select(
        F.col("g").alias("start"), (F.col("fit") % repeats + 1).alias("iteration"), (F.col("fit") < repeats).alias("has_2nd_nature"),
        "pr_auc", "f1", "mcc", (F.col("tp") + F.col("fn")).alias("positives"),
    )
