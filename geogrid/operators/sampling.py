"""Sampling that gives the same rows in every run: all chance comes from hashes of keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .neighbours import nearest_vectors
from .storage import stored
from .timeline import numbered


def first_by(df: DataFrame, by: list[str], order: list[Column], n: int | Column, into: str = "__nth") -> DataFrame:
    """The first n rows of each group; Spark keeps n of each task before it shuffles if n is a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(into, F.row_number().over(w)).where(F.col(into) <= n).drop(into)


def lowest(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest random number, ties by key; ranges of numbers are ranked, none of them alone."""
    x = numbered(df.withColumn("__o", F.struct(uniform(salt, key), F.col(key))), "__o", "__pos")
    return x.where(F.col("__pos") < n).drop("__o", "__pos")


def under_sample(df: DataFrame, label: str = "label", ratio: float = 0.1, salt: str = "s", key: str = "id") -> DataFrame:
    """All of the minority class and minority / ratio rows of the other, those with the smallest random number."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return df
    small, large = sorted(n, key=lambda k: (n[k], -k))
    most = min(n[large], int(n[small] / ratio))
    some = lowest(df.where(F.col(label) == large), salt, key, most)
    return df.where(F.col(label) == small).unionByName(some)


def group_split(df: DataFrame, ratio: float = 0.2, salt: str = "split", key: str = "id", group: str = "city_id", label: str = "is_city") -> DataFrame:
    """Adds ``part``: rows of no group are test with probability ``ratio``; of the groups that have a positive row
    int(n * ratio) are drawn, and all their rows are test, all rows of other groups train. No group is in both."""
    positive = df.where((F.col(label) == 1) & (F.col(group) > -1)).select(group).distinct()
    k = int(positive.count() * ratio)
    drawn = lowest(positive, salt + "g", group, k).withColumn("__drawn", F.lit(True))
    x = df.join(drawn, group, "left")
    test = F.when(F.col(group) > -1, F.coalesce("__drawn", F.lit(False))).otherwise(uniform(salt, key) < ratio)
    return x.withColumn("part", F.when(test, "test").otherwise("train")).drop("__drawn")


def row_split(df: DataFrame, ratio: float = 0.2, salt: str = "rows", key: str = "id") -> DataFrame:
    return df.withColumn("part", F.when(uniform(salt, key) < ratio, "test").otherwise("train"))


def resample_negatives(test: DataFrame, ratio: float = 0.1, label: str = "label", salt: str = "neg", key: str = "id") -> DataFrame:
    """All positives and positives / ratio negatives; an error if there are too few."""
    n = {r[label]: r["n"] for r in test.groupBy(label).agg(F.count("*").alias("n")).collect()}
    want = int(n.get(1, 0) / ratio)
    if n.get(0, 0) < want:
        raise ValueError(f"{want} negatives are wanted, {n.get(0, 0)} are there")
    return test.where(F.col(label) == 1).unionByName(lowest(test.where(F.col(label) == 0), salt, key, want))


def bootstrap_weights(df: DataFrame, replicates: int, by: str | None = None, key: str = "row_id", salt: str = "b") -> DataFrame:
    """(rep, [by,] ix, weight): how often row ``ix`` (numbered from 0, within its class if ``by`` is given) is drawn.

    Each replicate draws as many rows as the class has, with replacement; draws are ranges of numbers, dealt over all
    tasks, not rows, and are counted before they meet the data. ``df`` must have the numbers in a column ``ix``.
    """
    cls = [by] if by else []
    sizes = (df.groupBy(*cls) if cls else df).agg(F.count("*").alias("n")).where("n > 0").collect()  # a row for each class
    parts = []
    for r in sizes:
        n = r["n"]
        draws = df.sparkSession.range(n * replicates).select(F.floor(F.col("id") / n).cast("int").alias("rep"), (F.col("id") % n).alias("draw"), *[F.lit(r[c]).alias(c) for c in cls])
        name = F.concat(F.lit(salt), F.col("rep").cast("string"), F.lit("_"), *([F.col(by).cast("string"), F.lit("_")] if by else []))
        parts.append(draws.select("rep", *cls, F.floor(n * uniform(name, F.col("draw"))).cast("long").alias("ix")))
    if not parts:
        return df.select(F.lit(0).alias("rep"), *cls, F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("weight")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy("rep", *cls, "ix").agg(F.count("*").alias("weight"))


def poisson_copies(salt: str | Column, key: str) -> Column:
    """How often a row is drawn: Poisson of mean 1, from the key's random number."""
    u, at, total = uniform(salt, key), math.exp(-1), F.lit(0)
    below = at
    for k in range(1, 13):  # one row in 10^10 would get more
        total = total + (u >= below).cast("int")
        at /= k
        below += at
    return total


def smote(df: DataFrame, array: str, label: str = "label", minority: int = 1, k: int = 5, key: str = "id") -> DataFrame:
    """Synthetic minority rows (key, nth, array) that make the class as large as the other: random steps from a row
    towards one of its ``k`` nearest of the class.

    Each row of the class gets equally many, and those with the smallest random numbers one more. The neighbours are
    exact. There are none if the class has one row only, or is not the smaller one.
    """
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    own = n.get(minority, 0)
    wanted = max(0, sum(n.values()) - 2 * own)
    few = df.where(F.col(label) == minority).select(F.col(key).alias("id"), F.col(array).cast("array<double>").alias("a"))
    near = stored(nearest_vectors(few, "a", k).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nid"))).alias("near")), "near")
    each = few.join(near, "id").withColumn("times", F.lit(wanted // max(own, 1)))
    more = lowest(few.select("id"), "more", "id", wanted % max(own, 1)).withColumn("extra", F.lit(1))
    each = each.join(more, "id", "left").withColumn("times", F.col("times") + F.coalesce("extra", F.lit(0))).where("times > 0")
    x = each.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    name = F.concat_ws(":", "id", "nth")
    pick = F.floor(F.size("near") * uniform("pick", name)).cast("int")
    x = x.select("id", "nth", "a", F.get("near", pick)["nid"].alias("nid"), uniform("step", name).alias("step"))
    x = x.join(few.select(F.col("id").alias("nid"), F.col("a").alias("b")), "nid")
    return x.select(F.col("id").alias(key), "nth", F.zip_with("a", "b", lambda p, q: p + F.col("step") * (q - p)).alias(array))
