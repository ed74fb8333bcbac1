"""Ensembles, changes between scenarios, reports and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, ensemble, reports
from ..sources import fixtures as X
from .q_metrics import rounded
from .registry import query
from .sql import CELLS, PREDS

SUMMARY = f"{PREDS}, s AS (SELECT scenario, id, avg(prob) AS mean, stddev_pop(prob) AS std FROM preds GROUP BY ALL)"
CHANGE = f"{SUMMARY}, ch AS (SELECT a.id, b.mean - a.mean AS change, sqrt(a.std * a.std + b.std * b.std) AS change_std FROM s a JOIN s b ON a.id = b.id AND a.scenario = 'current' AND b.scenario = 'future')"


def _summaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = ensemble.summary(X.predictions(spark, d))
    return s.where("scenario = 'current'"), s.where("scenario = 'future'")


@query(f"WITH {SUMMARY} SELECT scenario, id, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def agg4_ensemble_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.summary(X.predictions(spark, d)), ["mean", "std"])


@query(f"WITH {CHANGE} SELECT id, round(change, 6) AS change, round(change_std, 6) AS change_std FROM ch")
def agg5_scenario_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.change(*_summaries(spark, d)), ["change", "change_std"])


@query(f"""WITH {CHANGE} SELECT count(*) AS n, round(avg(change), 6) AS mean, round(max(change), 6) AS high, round(min(change), 6) AS low, round(stddev_pop(change), 6) AS std,
  round(avg(change_std), 6) AS mean_std FROM ch""")
def agg6_change_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensemble.change_report(ensemble.change(*_summaries(spark, d))), ["mean", "high", "low", "std", "mean_std"])


@query("SELECT count(*) AS n_a, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_b, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_both FROM customer")
def jn10_same_ids(spark: SparkSession, d: str) -> DataFrame:
    a = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return ensemble.same_ids(a, X.table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query(f"WITH {CELLS}, {SUMMARY} SELECT c.id, c.country, round(a.mean, 6) AS mean_now, round(b.mean, 6) AS mean_later FROM cells c JOIN s a ON a.id = c.id AND a.scenario = 'current' JOIN s b ON b.id = c.id AND b.scenario = 'future'")
def jn14_joined_scenarios(spark: SparkSession, d: str) -> DataFrame:
    now, later = (x.select("id", "mean") for x in _summaries(spark, d))
    return rounded(ensemble.join_scenarios(X.cells(spark, d).select("id", "country"), {"now": now, "later": later}), ["mean_now", "mean_later"])


@query(f"""WITH {CELLS} SELECT (ceil(lon) - 1)::INT AS bin, ceil(lon) - 1 AS "left", ceil(lon) - 0.5 AS mid, ceil(lon) + 0.0::DOUBLE AS "right", count(x) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std,
  round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.25), 5) AS q25, round(quantile_cont(x, 0.75), 5) AS q75 FROM cells GROUP BY ceil(lon)""")
def agg7_longitude_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.bin_stats(X.cells(spark, d), "lon", "x"), ["mean", "std", "median", "q25", "q75"], 5)


@query("""WITH r AS (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders)
SELECT least(floor((o_totalprice - a) / w), 49)::INT AS bin, round(a + least(floor((o_totalprice - a) / w), 49) * w, 4) AS low, count(*) AS n FROM orders, r GROUP BY ALL""")
def agg17_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.histogram(X.table(spark, d, "orders"), "o_totalprice"), ["low"], 4)


@query("""WITH n AS (SELECT c_mktsegment AS segment, c_nationkey AS code, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT * FROM n UNION ALL SELECT NULL, code, sum(n) FROM n GROUP BY code),
  f AS (SELECT segment, code FROM (SELECT DISTINCT segment FROM t), range(1, 31) r(code))
SELECT f.segment, f.code::INT AS code, coalesce(t.n, 0)::BIGINT AS n FROM f LEFT JOIN t ON t.segment IS NOT DISTINCT FROM f.segment AND t.code = f.code""")
def agg13_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("code"))
    return reports.counts_filled(c, "code", range(1, 31), "segment")


@query("""SELECT l_returnflag AS model, round(avg(l_tax), 6) AS mean, round(avg(l_tax) - quantile_cont(l_tax, 0.025), 6) AS below, round(quantile_cont(l_tax, 0.975) - avg(l_tax), 6) AS above,
  list_position(['R', 'N'], l_returnflag)::INT AS place FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY l_returnflag""")
def agg24_error_bars(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import percentile_ci

    ci = percentile_ci(X.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "model"), ["l_tax"], ["model"])
    return rounded(reports.error_bars(ci, "l_tax", ["R", "N"]), ["mean", "below", "above"])


@query("SELECT l_shipdate, l_returnflag, list_position(['R', 'A', 'N'], l_returnflag)::INT AS place, count(*) AS n FROM lineitem GROUP BY ALL")
def srt3_custom_order(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.lit(["R", "A", "N"]), F.col("l_returnflag")).cast("int")
    n = X.table(spark, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(F.count("*").alias("n"))
    return n.withColumn("place", place).orderBy("l_shipdate", "place")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS u0, round(avg(embedding[2]::DOUBLE), 6) AS u1, count(*) AS n FROM embeddings GROUP BY label")
def agg14_centroids(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.centroids(_plane(spark, d), "label", ["u0", "u1"]), ["u0", "u1"])


def _plane(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d)
    return t.select("id", "label", F.col("px")[0].cast("double").alias("u0"), F.col("px")[1].cast("double").alias("u1"))


@query("""WITH c AS (SELECT label, avg(embedding[2]::DOUBLE) AS y FROM embeddings GROUP BY label), r AS (SELECT label, 'c' || lpad((row_number() OVER (ORDER BY y DESC, label))::VARCHAR, 2, '0') AS name FROM c)
SELECT vec_id AS id, name FROM embeddings JOIN r USING (label)""")
def win6_ranked_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.relabel(_plane(spark, d), "label", "u0", "u1").select("id", "name")


@query("""SELECT p_size AS k, round(avg(p_retailprice), 6) AS sse_mean, round(stddev_pop(p_retailprice), 6) AS sse_std, round(avg(p_partkey), 4) AS silhouette_mean,
  round(stddev_pop(p_partkey), 4) AS silhouette_std FROM part GROUP BY p_size""")
def agg11_sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = X.table(spark, d, "part").select(F.col("p_size").alias("k"), F.col("p_retailprice").alias("sse"), F.col("p_partkey").cast("double").alias("silhouette"))
    return rounded(rounded(clustering.sweep_summary(runs), ["sse_mean", "sse_std"]), ["silhouette_mean", "silhouette_std"], 4)
