"""Tables behind the figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


ACCURACY = 1000  # of the sketches that bracket a quantile: a rank is off by n / ACCURACY at most


def bin_stats(df: DataFrame, coord: str, value: str, width: float = 1.0, small: int = 10 * ACCURACY) -> DataFrame:
    """(bin, left, mid, right, n, mean, std, median, q25, q75) by bins (left, right] of a coordinate; empty bins have no row.

    Quantiles are exact and lie between the two values next to their place, as in linear interpolation. With the
    means a mergeable sketch of each bin says between which values a quantile is; a second pass counts what is below
    and ranks the distinct values in between alone, some thousandths of a bin. Bins of ``small`` rows or fewer are
    ranked as they are. So no task holds a large bin, and nothing is sorted as a whole.
    """
    b = F.ceil(F.col(coord) / width).cast("int") - 1
    x = df.where(F.col(coord).isNotNull()).select(b.alias("bin"), F.col(value).cast("double").alias("v"))
    places = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    around = [p for q in places.values() for p in (q - 3 / ACCURACY, q + 3 / ACCURACY)]
    n = stored(x.groupBy("bin").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile_approx("v", F.lit(around), ACCURACY).alias("p")), "bins")
    ask = [F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(q)).alias("place"), F.get("p", F.lit(2 * i)).alias("low"), F.get("p", F.lit(2 * i + 1)).alias("high")) for i, (name, q) in enumerate(places.items())]
    large = n.where(F.col("n") > small).select("bin", F.explode(F.array(*ask)).alias("a")).select("bin", "a.*")
    met = x.where("v is not null").join(large.select("bin", "name", "low", "high"), "bin").where("v <= high")
    met = met.groupBy("bin", "name", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    whole = x.where("v is not null").join(n.where(F.col("n") <= small).select("bin"), "bin").groupBy("bin", F.lit("").alias("name"), "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("bin", "name").orderBy(F.col("v").asc_nulls_first())  # what is below comes first
    ranked = met.unionByName(whole).withColumn("upto", F.sum("c").over(upto)).withColumn("before", F.col("upto") - F.col("c")).where("v is not null")
    at = ranked.join(n.select("bin", F.col("n").alias("__n")), "bin")
    cols = []
    for name, q in places.items():
        place = (F.col("__n") - 1) * F.lit(q)
        here = F.col("name").isin(name, "")
        of = lambda k: F.max(F.when(here & (F.col("before") <= k) & (k < F.col("upto")), F.col("v")))  # noqa: B023, E731
        low, high, part = of(F.floor(place)), of(F.ceil(place)), F.max(place - F.floor(place))
        cols.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(name))
    quantiles = at.groupBy("bin").agg(*cols)
    left = F.col("bin") * F.lit(float(width))
    return n.join(quantiles, "bin", "left").select("bin", left.alias("left"), (left + width / 2).alias("mid"), (left + width).alias("right"), "n", "mean", "std", "median", "q25", "q75")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, low, n): equal bins from the smallest to the largest value, the last one closed; empty bins have no row."""
    r = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    if r["a"] is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    w = (r["b"] - r["a"]) / bins or 1.0
    b = F.least(F.floor((F.col(col) - F.lit(r["a"])) / F.lit(w)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(r["a"]) + F.col("bin") * F.lit(w)).alias("low"), "n")


def mean_se(df: DataFrame, by: Iterable[str], metric: str) -> DataFrame:
    """(by..., n, mean, se, low, high): mean, standard error and the band of 1.96 of them."""
    x = df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se"))
    return x.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def counts_filled(df: DataFrame, key: str, domain: range, by: str) -> DataFrame:
    """(by, key, n) with a row for each key of the domain, and the totals of all groups under a null ``by``."""
    n = df.groupBy(by, key).agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast(df.schema[by].dataType)).select(by, key, "n")
    groups = n.select(by).distinct().unionByName(total.select(by).distinct()).distinct()
    full = groups.withColumn(key, F.explode(F.lit(list(domain))))
    every = n.unionByName(total).withColumnsRenamed({by: "__by", key: "__key"})
    return full.join(every, F.col(by).eqNullSafe(F.col("__by")) & (F.col(key) == F.col("__key")), "left").select(by, key, F.coalesce("n", F.lit(0)).alias("n"))


def error_bars(df: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """(model, mean, below, above, place) in a fixed order of models; others go."""
    place = F.array_position(F.lit(order), F.col("model")).cast("int")
    m = F.col(f"{metric}_mean")
    x = df.select("model", m.alias("mean"), (m - F.col(f"{metric}_low")).alias("below"), (F.col(f"{metric}_high") - m).alias("above"), place.alias("place"))
    return x.where("place > 0").orderBy("place")
