"""Scans and sinks: tables, CSV, catalogues of tiles, results by flag, predictions by model, reports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def partitioned(spark: SparkSession, path: str, **keys: object) -> DataFrame:
    """A table in folders such as dataset=x/year=1500; the keys prune folders."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def parse_tile_name(path: str = "path") -> tuple:
    """Year and id of names like Y1500_12.tiff; years may be negative; null where the name is another."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"(?:^|/)Y(-?\d+)_(\d+)\.tiff$", i), F.lit("")).try_cast("long")
    return part(1).alias("year"), part(2).alias("id")


def catalogue(spark: SparkSession, root: str, year: int | None = None) -> DataFrame:
    """(path, year, id) of all tiles below a folder; other names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    x = files.select("path", *parse_tile_name()).where("year is not null")
    return x if year is None else x.where(F.col("year") == year)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_results(df: DataFrame, path: str, flag: str = "has_2nd_nature") -> None:
    """CSV with a header, a folder for each value of the flag."""
    df.write.partitionBy(flag).csv(path, header=True)


def append_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("model_id").parquet(path)


def unfinished(spark: SparkSession, path: str, models: list[int]) -> list[int]:
    """Models that a prediction store lacks, for a restart."""
    want = spark.createDataFrame([(m,) for m in models], "model_id int")
    done = spark.read.parquet(path).select(F.col("model_id").cast("int").alias("model_id")).distinct()
    return [r["model_id"] for r in want.join(done, "model_id", "left_anti").orderBy("model_id").collect()]


def write_report(metrics: DataFrame, path: str, keys: list[str]) -> None:
    """Metrics (keys, tn, fp, fn, tp, accuracy, precision, recall, f1, mcc) as a summary in CSV, as JSON lines with the
    confusion matrix of each group, and as a report in words."""
    metrics.write.csv(f"{path}/summary", header=True)
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    metrics.select(*keys, matrix.alias("confusion_matrix"), "f1", "mcc").write.json(f"{path}/detail")
    said = lambda c: F.concat(F.lit(f", {c} "), F.when(F.col(c).isNull(), "none").otherwise(F.format_string("%.4f", F.col(c))))
    head = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in keys])
    rows = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    line = F.concat(head, F.lit(": rows "), rows.cast("string"), *map(said, ("accuracy", "precision", "recall", "f1", "mcc")))
    metrics.select(line.alias("value")).write.text(f"{path}/report")


def write_embeddings(df: DataFrame, path: str, per_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", per_file).parquet(path)


def read_config(spark: SparkSession, path: str) -> Mapping[str, Mapping]:
    """A nested JSON configuration: dataset -> feature set -> parameters."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
