"""Image tiles as arrays of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(px: str | Column) -> Column:
    px = F.col(px) if isinstance(px, str) else px
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(px)


def std(px: str | Column) -> Column:
    """Sample deviation, null for a single pixel."""
    px = F.col(px) if isinstance(px, str) else px
    m = mean(px)
    return F.sqrt(F.try_divide(F.aggregate(px, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(px) - 1))


def stats(df: DataFrame, px: str = "px") -> DataFrame:
    """Adds mean and std of each tile."""
    return df.withColumn("mean", mean(px)).withColumn("std", std(px))


def normalise(px: str, eps: float = 1e-6) -> Column:
    """(v - mean) / (std + eps), with ``mean`` and ``std`` columns beside the tile."""
    return F.transform(px, lambda v: (v - F.col("mean")) / (F.col("std") + eps))


def water_signs(px: str | Column) -> Column:
    """1 where there is water, -1 where not."""
    return F.transform(px, lambda v: F.when(v > 0, 1.0).otherwise(-1.0))


def channel_normalise(px: str | Column, mu: float, sigma: float) -> Column:
    return F.transform(px, lambda v: (v - mu) / sigma)


def pair(dem: DataFrame, wet: DataFrame) -> DataFrame:
    """(id, mean, std, px): two channels, normalised elevation and water signs."""
    x = stats(dem).join(wet.select("id", F.col("px").alias("__wet")), "id")
    return x.select("id", "mean", "std", F.array(normalise("px"), water_signs("__wet")).alias("px"))
