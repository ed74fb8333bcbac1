"""Years: windows, as-of joins, labels, eligibility and smoothing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored


def eligible(df: DataFrame, start: int | Column, end: int | Column, birth: str = "birth", label: str = "is_city") -> DataFrame:
    """Towns founded before the window go, towns founded after its end become non-towns; missing years stay as they are."""
    for c in (birth, label):
        if c not in df.columns:
            raise ValueError(f"column {c} is missing")
    town = F.col(label) == 1
    kept = df.where(~F.coalesce((F.col(birth) < start) & town, F.lit(False)))
    return kept.withColumn(label, F.when(F.coalesce((F.col(birth) > end) & town, F.lit(False)), 0).otherwise(F.col(label)).cast("int"))


def between_years(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    return df.where(F.col(col).between(low, high))


def hopping_windows(df: DataFrame, col: str, size: int = 300, step: int = 50) -> DataFrame:
    """(start, end, mid): windows [start, end) from the smallest year on, the last one within the largest; no rows if none fits."""
    r = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).where(F.col("b") - size >= F.col("a"))
    s = r.select(F.explode(F.sequence(F.col("a"), F.col("b") - size, F.lit(step))).alias("start"))
    return s.select("start", (F.col("start") + size).alias("end"), (F.col("start") + size / 2.0).alias("mid"))


def assign_windows(df: DataFrame, windows: DataFrame, col: str) -> DataFrame:
    """Each row once for every window [start, end) that its year is in.

    Windows are of one size and begin at steps of one size, as those of ``hopping_windows``: which of them a year is
    in follows from the year, so rows are unfolded and looked up by start. Windows may be left out of ``windows``.
    """
    s = windows.agg(F.min("start").alias("a"), F.max(F.col("end") - F.col("start")).alias("size"), F.min(F.col("end") - F.col("start")).alias("least")).first()
    if s["a"] is None:
        return df.join(windows, F.lit(False))
    if s["size"] != s["least"]:
        raise ValueError("windows are of different sizes")
    nxt = windows.select("start").distinct().withColumn("gap", F.col("start") - F.lit(s["a"]))
    steps = [r["gap"] for r in nxt.where("gap > 0").select("gap").collect()]  # a number for each window
    step = math.gcd(*steps) if steps else s["size"]
    first = F.floor((F.col(col) - F.lit(s["a"] + s["size"])) / F.lit(step)) + 1
    last = F.floor((F.col(col) - F.lit(s["a"])) / F.lit(step))
    own = F.explode(F.when(last >= first, F.transform(F.sequence(first, last), lambda k: (F.lit(s["a"]) + k * F.lit(step)).cast("int"))))
    return df.withColumn("__start", own).join(windows, F.col("__start") == F.col("start")).drop("__start")


def windows_with_min(df: DataFrame, windows: DataFrame, col: str, least: int = 300) -> DataFrame:
    """(start, end, n) of windows with at least ``least`` rows."""
    return assign_windows(df, windows, col).groupBy("start", "end").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def asof_forward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, default: int | None = None) -> DataFrame:
    """``left`` with ``matched``: the smallest value of ``right_on`` that is not before ``left_on``.

    Both sides go through one ordered window over their distinct values, blocks of years at a time, so neither is
    broadcast and no pair of rows is formed.
    """
    span = 1024
    keys = right.select(F.col(right_on).cast("long").alias("v")).where("v is not null").distinct()
    asks = left.select(F.col(left_on).cast("long").alias("t")).where("t is not null").distinct()
    block = lambda c: F.floor(F.col(c) / span)
    # The first key of each later block, for asks after their own block's last key.
    firsts = keys.groupBy(block("v").alias("g")).agg(F.min("v").alias("lead"))
    both = keys.select(block("v").alias("g"), F.col("v").alias("at"), F.col("v").alias("key")).unionByName(
        asks.select(block("t").alias("g"), F.col("t").alias("at"), F.lit(None).cast("long").alias("key"))
    )
    after = Window.partitionBy("g").orderBy("at", F.col("key").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    own = both.withColumn("own", F.first("key", ignorenulls=True).over(after)).where("key is null").select("g", "at", "own")
    ahead = own.where("own is null").select("g").distinct().unionByName(firsts.select("g"), allowMissingColumns=True).distinct()
    ahead = ahead.join(firsts, "g", "left")
    rest = Window.orderBy("g").rowsBetween(1, Window.unboundedFollowing)  # a row for each block of years
    ahead = ahead.select("g", F.first("lead", ignorenulls=True).over(rest).alias("ahead"))
    found = own.join(ahead, "g", "left").select(F.col("at").alias("__t"), F.coalesce("own", "ahead").alias("matched"))
    x = left.join(found, F.col(left_on).cast("long") == F.col("__t"), "left").drop("__t")
    return x if default is None else x.withColumn("matched", F.coalesce("matched", F.lit(default)))


def label_interval(df: DataFrame, col: str, periods: list[tuple[str, float, float]], closed: str = "left", into: str = "period") -> DataFrame:
    """The name of the interval that a value is in, null outside all: [lo, hi) or, closed on the right, (lo, hi]."""
    x = F.col(col)
    inside = (lambda lo, hi: (x >= lo) & (x < hi)) if closed == "left" else (lambda lo, hi: (x > lo) & (x <= hi))
    name: Column = F.lit(None).cast("string")
    for label, lo, hi in reversed(periods):
        name = F.when(inside(lo, hi), F.lit(label)).otherwise(name)
    return df.withColumn(into, name)


def regional_series(cube: DataFrame, members: DataFrame, offset: float = 0.0) -> DataFrame:
    """(t, value): unweighted mean over the cells of a region at each time, plus an offset."""
    return cube.join(members, "cell", "left_semi").groupBy("t").agg((F.avg("value") + offset).alias("value"))


def numbered(df: DataFrame, order: str, into: str = "pos", parts: int | None = None) -> DataFrame:
    """Positions from 0 in order of ``order``: ranges are numbered each by itself and start where the ones before end."""
    spark: SparkSession = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An eager cut: both uses must see the same ranges.
    cut = stored(df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return cut.withColumn("__own", own).join(sizes, "__part").withColumn(into, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def kernel(sigma: float) -> list[float]:
    """Normalised Gaussian weights of radius int(4 sigma + 0.5)."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, order: str, value: str, sigma: float = 5.0, rows: int = 1 << 16) -> DataFrame:
    """(pos, order, value, smoothed): Gaussian smoothing over positions, the series mirrored at its ends (edge repeated).

    The series is cut into ranges of ``rows`` positions. Each gets copies of its neighbours' values within the
    kernel's radius, the ends their mirror images, and is smoothed by a window of its own. So what is shuffled is the
    series and two radii a range, and it is never in one task.
    """
    w = kernel(sigma)
    r = len(w) // 2
    rows = max(rows, r)  # so that a value is within the radius of neighbouring ranges only
    x = stored(numbered(df.select(order, value), order), "positions")
    n = x.count()
    if n == 0:
        return x.select("pos", order, value, F.lit(None).cast("double").alias("smoothed"))
    outside = x.sparkSession.range(2 * r).select(F.when(F.col("id") < r, F.col("id") - r).otherwise(F.lit(n - r) + F.col("id")).alias("to"))
    turn = F.pmod(F.col("to"), F.lit(2 * n))
    mirrored = outside.withColumn("pos", F.least(turn, F.lit(2 * n - 1) - turn)).join(x, "pos").select(F.col("to").alias("pos"), order, value)
    every = x.select("pos", order, value).unionByName(mirrored)
    part = lambda p: F.floor(p / F.lit(rows))
    near = F.array_distinct(F.transform(F.array(F.lit(-r), F.lit(0), F.lit(r)), lambda k: part(F.col("pos") + k)))
    dealt = every.select("*", F.explode(near).alias("__part"))
    along = Window.partitionBy("__part").orderBy("pos")
    taps = [F.lead(value, k).over(along) if k > 0 else F.lag(value, -k).over(along) if k else F.col(value) for k in range(-r, r + 1)]
    found = dealt.withColumn("smoothed", reduce(lambda a, b: a + b, [F.coalesce(t * F.lit(c), F.lit(0.0)) for t, c in zip(taps, w, strict=True)]))
    return found.where((part(F.col("pos")) == F.col("__part")) & F.col("pos").between(0, n - 1)).select("pos", order, value, "smoothed")


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
