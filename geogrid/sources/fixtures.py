"""Grid, town, raster and prediction tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform as u


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells: id, x, y, lon, lat, country, is_city, birth, city_id."""
    k = F.col("c_custkey")
    city = u("ic", k) < 0.2
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (2000 * u("gx", k)).alias("x"),
        (2000 * u("gy", k)).alias("y"),
        (360 * u("lo", k) - 180).alias("lon"),
        (180 * u("la", k) - 90).alias("lat"),
        (F.col("c_nationkey") % 2).cast("int").alias("country"),
        city.cast("int").alias("is_city"),
        F.when(city, F.floor(-400 + 2300 * u("bb", k))).cast("int").alias("birth"),
        F.when(city, k % 37).otherwise(-1).cast("long").alias("city_id"),
        F.col("c_acctbal").alias("elevation"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towns: city_id, x, y, birth, end_yr."""
    k = F.col("s_suppkey")
    birth = F.floor(-400 + 23 * F.floor(100 * u("b", k))).cast("int")
    return table(spark, sf_dir, "supplier").select(
        k.alias("city_id"),
        (2000 * u("cx", k)).alias("x"),
        (2000 * u("cy", k)).alias("y"),
        birth.alias("birth"),
        (birth + F.floor(200 + 600 * u("e", k))).cast("int").alias("end_yr"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster as rows: row, col, value (-9999 where it has no data), gap."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("key"),
        F.floor(k / 50).cast("int").alias("row"),
        (k % 50).cast("int").alias("col"),
        F.when(u("nd", k) < 0.05, -9999.0).otherwise(F.col("p_retailprice")).alias("value"),
        (u("gap", k) < 0.1).alias("gap"),
        F.col("p_retailprice").alias("price"),
    )


def crop_yields(spark: SparkSession, sf_dir: str, crops: tuple[str, ...] = ("c1", "c2", "c3")) -> DataFrame:
    """row, col, crop, yield."""
    crop = F.explode(F.array(*map(F.lit, crops)))
    x = pixels(spark, sf_dir).withColumn("crop", crop)
    return x.select("key", "row", "col", "crop", F.floor(F.col("price") * u(F.col("crop"), F.col("key")) - 150).cast("double").alias("yield"))


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, model, row, col, raw: two scenarios of five models, one of which is missing in the second."""
    x = pixels(spark, sf_dir).withColumn("scenario", F.explode(F.array(F.lit("s1"), F.lit("s2"))))
    x = x.withColumn("model", F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])))
    raw = F.floor(1000 * u(F.concat("scenario", "model"), F.col("key"))).cast("double")
    return x.where("not (scenario = 's2' and model = 'm4')").select("scenario", "model", "row", "col", raw.alias("raw"))


def predictions(spark: SparkSession, sf_dir: str, models: int = 10) -> DataFrame:
    """scenario, model_id, id, prob."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    x = x.withColumn("scenario", F.explode(F.array(F.lit("current"), F.lit("future"))))
    x = x.withColumn("model_id", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    return x.select("scenario", "model_id", "id", u(F.concat("scenario", F.col("model_id").cast("string")), F.col("id")).alias("prob"))


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, score, tax, flag of each line, without a row number."""
    label = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20)).cast("int")
    return table(spark, sf_dir, "lineitem").select(label.alias("label"), F.col("l_discount").alias("score"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (hours of events, numbered), value (mean)."""
    x = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return x.select("hour", "value")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, px: 8 x 8 pixels, row by row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("px"), "label")
