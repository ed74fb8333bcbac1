"""Ensembles of models and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_mean(px: DataFrame, keys: list[str], n_models: int) -> DataFrame:
    """(keys..., mean, n, coverage): mean over the models that are there; coverage is full, partial or poor (under half)."""
    x = px.groupBy(*keys).agg(F.avg("value").alias("mean"), F.countDistinct("model").alias("n"))
    c = F.when(F.col("n") == n_models, "full").when(F.col("n") * 2 >= n_models, "partial").otherwise("poor")
    return x.withColumn("coverage", c)


def missing_models(px: DataFrame, scenarios: list[str], models: list[str]) -> DataFrame:
    """(scenario, model) that should be there and are not."""
    spark = px.sparkSession
    want = spark.createDataFrame([(s, m) for s in scenarios for m in models], "scenario string, model string")
    return want.join(px.select("scenario", "model").distinct(), ["scenario", "model"], "left_anti")


def summary(preds: DataFrame) -> DataFrame:
    """(scenario, id, mean, std) over models; population deviation."""
    return preds.groupBy("scenario", "id").agg(F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"))


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, n_both) of two scenarios' ids."""
    both = a.select("id").distinct().withColumn("a", F.lit(1)).join(b.select("id").distinct().withColumn("b", F.lit(1)), "id", "full")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


def change(current: DataFrame, future: DataFrame) -> DataFrame:
    """(id, change, change_std): difference of means, and the root of the summed variances."""
    c = current.select("id", F.col("mean").alias("m0"), F.col("std").alias("s0"))
    f = future.select("id", F.col("mean").alias("m1"), F.col("std").alias("s1"))
    return c.join(f, "id").select("id", (F.col("m1") - F.col("m0")).alias("change"), F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")).alias("change_std"))


def change_report(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count("*").alias("n"), F.avg("change").alias("mean"), F.max("change").alias("high"), F.min("change").alias("low"),
        F.stddev_pop("change").alias("std"), F.avg("change_std").alias("mean_std"),
    )


def join_scenarios(cells: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Cells with each scenario's columns, named for it; cells that a scenario lacks go."""
    named = [df.select("id", *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "id"]) for k, df in parts.items()]
    return reduce(lambda a, b: a.join(b, "id"), named, cells)
