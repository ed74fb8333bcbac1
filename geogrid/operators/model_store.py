"""A store of boosted models: fitted some at a time, resumed where it stopped, and scored in one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from . import boosting, sampling
from .storage import stored

ROW = (
    "model_id int, seed string, state string, reason string, features array<string>, means array<double>, stds array<double>, base double, "
    "trees int, depth int, feature array<int>, threshold array<double>, value array<double>"
)


class ModelStore:
    """Bootstrap models in a folder, a row for each: seed, state, order of features, scaler, and the trees as arrays.

    Rows are committed as Parquet files, a file for the models that were fitted together; Spark renames a file into
    place when it is whole, so a run that is killed leaves the models it had finished, and the next run fits the
    others alone. A model that can't be fitted has a row that says why, and is tried again by the next run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/models"

    def rows(self) -> DataFrame:
        """The latest row of each model; none if nothing has been stored."""
        try:
            found = self.spark.read.schema(ROW + ", run long").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ROW)
        latest = found.groupBy("model_id").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("model_id", "run")]), "run").alias("m"))
        return latest.select("model_id", "m.*")

    def _commit(self, rows: list[tuple]) -> None:
        run = 1 + (self.spark.read.parquet(self.path).agg(F.max("run")).first()[0] if not self.rows().isEmpty() else 0)
        df = self.spark.createDataFrame([(*r, run) for r in rows], ROW + ", run long")
        df.coalesce(1).write.mode("append").parquet(self.path)

    def unfinished(self, models: int) -> list[int]:
        done = {r["model_id"] for r in self.rows().where("state = 'fitted'").select("model_id").collect()}
        return [m for m in range(models) if m not in done]

    def train(
        self, df: DataFrame, features: list[str], models: int = 300, label: str = "label", key: str = "id", ratio: float = 0.1,
        at_once: int = 100, settings: boosting.Settings = boosting.Settings(), salt: str = "",
    ) -> list[int]:
        """Fits the models that the store lacks, ``at_once`` together, and returns which it fitted.

        Each model has its own bootstrap sample (a row's number of copies is Poisson of mean 1, from a hash of model
        and key), its own under-sample of the larger class (rows stay with the chance that leaves minority / ratio of
        them), and its own scaler. No row is copied for a model: rows carry a weight for each.
        """
        fitted = []
        rows = df.select(F.lit(0).alias("g"), F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"), F.array(F.col(label).cast("double")).alias("y"))
        todo = self.unfinished(models)
        for at in range(0, len(todo), at_once):
            some = todo[at : at + at_once]
            names = F.array(*[F.lit(f"{salt}{m}") for m in some])
            copies = F.transform(names, lambda m: sampling.poisson_copies(F.concat(F.lit("boot"), m), "id"))
            drawn = rows.withColumn("copies", copies)
            n = {(r["m"], r["label"]): r["n"] for r in drawn.select(F.get("y", F.lit(0)).alias("label"), F.posexplode("copies").alias("m", "c")).groupBy("m", "label").agg(F.sum("c").alias("n")).collect()}
            rates = [[_rate(n.get((i, 0.0), 0), n.get((i, 1.0), 0), ratio, y) for i in range(len(some))] for y in (0, 1)]
            weighed = stored(drawn.withColumn("w", _kept(names, rates)).drop("copies"), "weighed")
            fits = boosting.Fits(len(some), np.ones((len(some), len(features)), bool), settings=settings)
            means, stds = _scalers(weighed, fits, len(features))
            forest = boosting.fit(weighed, fits).get(0)
            self._commit([_row(m, f"{salt}{m}", i, features, means, stds, forest) for i, m in enumerate(some)])
            fitted += some
        return fitted

    def forests(self, df: DataFrame, bound: int = 256 << 20) -> tuple[list[tuple[list[int], list[str], boosting.Forest]], list[tuple[int, str]]]:
        """Groups of models for ``df``, each of at most ``bound`` bytes of trees, and the models that fail, with the reason."""
        groups: dict[tuple, list] = {}
        failing: list[tuple[int, str]] = []
        for r in self.rows().orderBy("model_id").toLocalIterator():
            lacking = [c for c in r["features"] or () if c not in df.columns]
            nodes = (r["trees"] or 0) * (2 ** (r["depth"] or 0) - 1)
            if r["state"] != "fitted":
                failing.append((r["model_id"], r["reason"]))
            elif lacking:
                failing.append((r["model_id"], f"columns are missing: {', '.join(lacking)}"))
            elif len(r["feature"]) != nodes or len(r["threshold"]) != nodes or len(r["value"]) != nodes + r["trees"]:
                failing.append((r["model_id"], "its trees are incomplete"))
            else:
                kind = (tuple(r["features"]), r["trees"], r["depth"])
                size = 28 * nodes + 16 * len(r["features"])
                if kind not in groups or (groups[kind][-1][0] + size > bound and groups[kind][-1][1]):
                    groups.setdefault(kind, []).append([0, []])
                groups[kind][-1][0] += size
                groups[kind][-1][1].append(r)
        out = []
        for (features, trees, depth), parts in groups.items():
            for _, rows in parts:
                of = lambda c, *shape, rows=rows: np.array([r[c] for r in rows]).reshape(len(rows), *shape)
                forest = boosting.Forest(
                    of("base").astype(float), of("feature", trees, 2**depth - 1).astype(np.int32), of("threshold", trees, 2**depth - 1).astype(float), of("value", trees, 2**depth).astype(float),
                    np.zeros(len(rows), bool), np.ones(len(rows)), np.ones(len(rows)), of("means", len(features)).astype(float), of("stds", len(features)).astype(float),
                )
                out.append(([r["model_id"] for r in rows], list(features), forest))
        return out, failing

    def predict(self, df: DataFrame, key: str = "id", bound: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
        """(key, model_id, prob) of every row by each model, one scan for each group of models; and (model_id, reason) of
        the models that fail, which are left out. Features are taken by name, in the order that a model has learnt."""
        parts, failing = self.forests(df, bound)
        out = df.select(F.col(key), F.lit(None).cast("int").alias("model_id"), F.lit(None).cast("double").alias("prob")).where("false")
        for models, features, forest in parts:
            x = df.select(F.lit(0).alias("g"), F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
            found = boosting.score(x, {0: forest}).select(F.col("id").alias(key), F.get(F.lit(models), F.col("fit")).cast("int").alias("model_id"), F.col("score").alias("prob"))
            out = found if out is None or len(parts) == 1 else out.unionByName(found)
        return out, self.spark.createDataFrame(failing, "model_id int, reason string")


def _kept(names: Column, rates: list[list[float]]) -> Column:
    """The copies of a row that stay, for each model; ``rates`` has the chances of rows of label 0 and of label 1."""
    rate = F.when(F.get("y", F.lit(0)) == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    chance = lambda i: uniform(F.concat(F.lit("under"), F.get(names, i)), "id")
    return F.transform("copies", lambda c, i: F.when(chance(i) < F.get(rate, i), c).otherwise(0).cast("tinyint"))


def _rate(zeros: int, ones: int, ratio: float, label: int) -> float:
    """The chance with which rows of a label stay: the smaller class whole, of the other smaller / ratio rows."""
    own, other = (ones, zeros) if label else (zeros, ones)
    return 1.0 if own <= other or not other else min(1.0, other / ratio / own)


def _scalers(rows: DataFrame, fits: boosting.Fits, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 for 0) of the features as each fit weighs the rows."""

    def made(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for g, v, row, each, _, weights in fits.read(b):
            w = np.zeros((len(v), fits.n))
            w[row, each] = weights
            yield g, np.stack((np.repeat(w.sum(0)[:, None], d, 1), w.T @ v, w.T @ (v * v)), axis=2)

    x = boosting.summed(rows, made, (d, 3), fits.n).get(0)
    if x is None:
        return np.zeros((fits.n, d)), np.ones((fits.n, d))
    n, one, two = (x.reshape(fits.n, d, 3)[:, :, k] for k in range(3))
    mean = one / np.maximum(n, 1)
    std = np.sqrt(np.maximum(two / np.maximum(n, 1) - mean**2, 0))
    return mean, np.where(std > 1e-12, std, 1.0)


def _row(model: int, seed: str, i: int, features: list[str], means: np.ndarray, stds: np.ndarray, forest: boosting.Forest | None) -> tuple:
    if forest is None or not 0 < forest.labels[i] < forest.weights[i]:
        return (model, seed, "failed", "its sample has one class only", features, None, None, None, None, None, None, None, None)
    j = forest.feature[i]
    scaled = (forest.threshold[i] - means[i][j]) / stds[i][j]
    trees, nodes = j.shape
    flat = lambda x: x.reshape(-1).tolist()
    return (model, seed, "fitted", None, features, means[i].tolist(), stds[i].tolist(), float(forest.base[i]), trees, int(np.log2(nodes + 1)), flat(j), flat(scaled), flat(forest.value[i]))
