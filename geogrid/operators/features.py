"""Feature tables: choosing, joining, scaling and describing columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("is_city", "city", "city_id", "birth", "l_grid_id", "year", "id")


def expand(df: DataFrame, array: str, prefix: str, n: int) -> DataFrame:
    """An array column as ``n`` columns prefix0, prefix1, ..."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)])


def pack(df: DataFrame, prefix: str, array: str) -> DataFrame:
    """The columns prefix0, prefix1, ... as one array column, in order of their numbers."""
    cols = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*[c for c in df.columns if c not in cols], F.array(*cols).alias(array))


def groups(df: DataFrame, prefixes: dict[str, str], named: dict[str, Iterable[str]], skip: Iterable[str] = ()) -> dict[str, list[str]]:
    """Feature columns by group: by prefix and a number, or by name; labels and ``skip`` belong to none."""
    free = [c for c in df.columns if c not in LABELS and c not in set(skip)]
    out = {g: [c for c in free if c.startswith(p) and c[len(p) :].isdigit()] for g, p in prefixes.items()}
    return out | {g: [c for c in free if c in set(cols)] for g, cols in named.items()}


def matrix(df: DataFrame, drop: Iterable[str]) -> DataFrame:
    """All columns but some, in order of their names."""
    return df.select(*sorted(set(df.columns) - set(drop)))


def drop_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def drop_containing(df: DataFrame, part: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if part in c])


def suffixed(df: DataFrame, suffix: str, measures: Iterable[str]) -> DataFrame:
    """Measures named for a scenario; unnamed index columns are dropped."""
    kept = df.drop(*[c for c in df.columns if c.startswith("Unnamed")])
    return kept.withColumnsRenamed({m: f"{m}_{suffix}" for m in measures})


def standard_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where they exist; a name that is there already wins over one that would be renamed to it."""
    present = set(df.columns)
    clash = [a for a, b in names.items() if a in present and b in present and a != b]
    return df.drop(*clash).withColumnsRenamed({a: b for a, b in names.items() if a in present and a not in clash})


def check_same_columns(train: DataFrame, test: DataFrame) -> None:
    if set(train.columns) != set(test.columns):
        raise ValueError(f"columns differ: {sorted(set(train.columns) ^ set(test.columns))}")


def join_families(base: DataFrame, *families: DataFrame, on: str | list[str] = "id", how: str = "inner") -> DataFrame:
    """A star of feature tables; all join on one key, so one partitioning serves them all."""
    return reduce(lambda a, b: a.join(b, on, how), families, base)


def lookup(df: DataFrame, dim: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Add a dimension's columns; Spark broadcasts it if it is small enough."""
    return df.join(dim, key, how)


def unmatched(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``a`` whose key ``b`` doesn't have."""
    return a.join(b, on, "left_anti")


def union_tagged(parts: dict[str, DataFrame], tag: str = "region") -> DataFrame:
    """All parts below one another, with a column that says which; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in parts.items()])


def fit_scaler(df: DataFrame, array: str) -> DataFrame:
    """(dim, mean, std) of an array column: population deviation, 1 where it is 0."""
    x = df.select(F.posexplode(array).alias("dim", "v")).groupBy("dim")
    x = x.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s"))
    return x.select("dim", "mean", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("std"))


def scaler_arrays(params: DataFrame) -> DataFrame:
    """The parameters as one row (means, stds); as many values as the features have dimensions."""
    p = params.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("p"))
    return p.select(F.col("p.mean").alias("means"), F.col("p.std").alias("stds"))


def apply_scaler(df: DataFrame, params: DataFrame, array: str) -> DataFrame:
    """(v - mean) / std for each dimension. The parameters, a number for each dimension, travel as a literal."""
    row = scaler_arrays(params).first()
    z = lambda v, i: (v - F.get(means, i)) / F.get(stds, i)
    means, stds = (F.lit(list(x or [0.0])) for x in (row["means"], row["stds"]))
    return df.withColumn(array, F.transform(array, z))


def positive_range(df: DataFrame, col: str) -> DataFrame:
    """(low, high) of the positive values."""
    x = F.when(F.col(col) > 0, F.col(col))
    return df.agg(F.min(x).alias("low"), F.max(x).alias("high"))


def dense_index(df: DataFrame, col: str, into: str = "index") -> DataFrame:
    """Categories numbered from 0 in their order, null left null; the categories are ranked, not the rows."""
    kinds = df.select(col).where(F.col(col).isNotNull()).distinct()
    kinds = kinds.withColumn(into, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(kinds, col, "left")


def describe(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(feature, n, missing, mean, std, low, high) in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
    x = df.select(pairs.alias("p")).select("p.*").groupBy("feature")
    return x.agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
    )


def summary(df: DataFrame, label: str, group: str) -> DataFrame:
    """(label, n, n_groups): rows and distinct groups of each class."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.countDistinct(group).alias("n_groups"))


def any_of(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))
