"""Sampling, and model jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import boosting, clustering, experiments, features, metrics, model_store, models, neighbours, sampling, spatial, timeline
from ..operators.storage import scratch, stored
from ..sources import fixtures as X
from ..sources import tables
from .registry import query
from .sql import CELLS, LINES, u


@query(f"""WITH p AS (SELECT c_custkey AS id, ({u("ic", "c_custkey")} < 0.2)::INT AS label FROM customer), k AS (SELECT min(n) AS small, max(n) AS large FROM (SELECT count(*) AS n FROM p GROUP BY label))
SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u("s", "id")}, id) AS r FROM p), k WHERE label = 1 OR r <= least(large, floor(small / 0.5::DOUBLE))""")
def smp1_under_sample(spark: SparkSession, d: str) -> DataFrame:
    x = X.cells(spark, d).select("id", F.col("is_city").alias("label"))
    return sampling.under_sample(x, ratio=0.5)


@query(f"""WITH {CELLS}, g AS (SELECT DISTINCT city_id FROM cells WHERE is_city = 1 AND city_id > -1), k AS (SELECT floor(count(*) * 0.2::DOUBLE) AS k FROM g
), t AS (SELECT city_id FROM (SELECT city_id, row_number() OVER (ORDER BY {u("splitg", "city_id")}, city_id) AS r FROM g), k WHERE r <= k)
SELECT id, CASE WHEN CASE WHEN city_id > -1 THEN city_id IN (SELECT city_id FROM t) ELSE {u("split", "id")} < 0.2 END THEN 'test' ELSE 'train' END AS part FROM cells""")
def smp3_group_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.group_split(X.cells(spark, d)).select("id", "part")


@query(f"""WITH {CELLS}, g AS (SELECT DISTINCT city_id FROM cells WHERE is_city = 1 AND city_id > -1), k AS (SELECT floor(count(*) * 0.2::DOUBLE) AS k FROM g
), t AS (SELECT city_id FROM (SELECT city_id, row_number() OVER (ORDER BY {u("splitg", "city_id")}, city_id) AS r FROM g), k WHERE r <= k)
SELECT {u("split", "id")} < 0.2 AS drawn, city_id IN (SELECT city_id FROM t) AS moved, count(*) AS n FROM cells WHERE city_id > -1 GROUP BY 1, 2""")
def set3_moved_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of towns by where a plain row split has them and where their town moves them."""
    x = sampling.group_split(X.cells(spark, d)).where("city_id > -1").withColumnRenamed("part", "to")
    x = sampling.row_split(x, salt="split")
    return x.groupBy((F.col("part") == "test").alias("drawn"), (F.col("to") == "test").alias("moved")).agg(F.count("*").alias("n"))


@query(f"""WITH {CELLS}, p AS (SELECT count(*) FILTER (is_city = 1) AS n FROM cells) SELECT id FROM (SELECT id, is_city, row_number() OVER (PARTITION BY is_city ORDER BY {u("neg", "id")}, id) AS r FROM cells), p
WHERE is_city = 1 OR r <= floor(n / 0.5::DOUBLE)""")
def smp4_resampled_negatives(spark: SparkSession, d: str) -> DataFrame:
    x = X.cells(spark, d).select("id", F.col("is_city").alias("label"))
    return sampling.resample_negatives(x, 0.5).select("id")


@query(f"""WITH n AS (SELECT count(*) AS n FROM part), w AS (SELECT rep, floor(n * {u("='b' || rep || '_'", "draw")})::BIGINT AS ix, count(*) AS weight FROM (SELECT n, unnest(range(n)) AS draw FROM n), range(3) r(rep) GROUP BY ALL)
SELECT rep::INT AS rep, p_partkey AS ix, weight FROM w JOIN part ON p_partkey = ix""")
def smp5_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("ix"))
    return sampling.bootstrap_weights(p, 3).join(p, "ix").select("rep", "ix", "weight")


@query(f"""WITH {CELLS}, s AS (SELECT *, CASE WHEN {u("rows", "id")} < 0.2 THEN 'test' ELSE 'train' END AS part FROM cells), p AS (SELECT avg(elevation) AS m, stddev_pop(elevation) AS s FROM s WHERE part = 'train')
SELECT part, count(*) AS n, round(avg((elevation - m) / p.s), 6) AS mean FROM s, p GROUP BY part""")
def smp7_scaled_split(spark: SparkSession, d: str) -> DataFrame:
    """Train and test by one scaler, fitted on train rows."""
    x = sampling.row_split(X.cells(spark, d)).select("part", F.array("elevation").alias("px"))
    z = features.apply_scaler(x, features.fit_scaler(x.where("part = 'train'"), "px"), "px")
    return z.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.col("px")[0]), 6).alias("mean"))


@query(f"WITH {CELLS} SELECT id, CASE WHEN {u('rows', 'id')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM cells")
def smp9_row_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.row_split(X.cells(spark, d)).select("id", "part")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors with a label that their first numbers decide."""
    t = X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px"))
    return t.withColumn("label", (F.col("px")[0] + F.col("px")[1] > 0).cast("int")).withColumn("city_id", F.col("id") % 23)


def minority(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors of a class and the rest; the class is the smaller part."""
    return X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px"), (F.col("label") % 3 == 0).cast("int").alias("label"))


NEAR_SQL = """m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label % 3 = 0
), near AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM m a JOIN m b ON a.id <> b.id QUALIFY rank <= 5)"""


@query(f"WITH {NEAR_SQL} SELECT id, nid, rank::INT AS rank, round(d, 5) AS d FROM near")
def smp2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of its class for each vector of the smaller class, exact."""
    x = neighbours.nearest_vectors(minority(spark, d).where("label = 1"), "px")
    return x.select("id", "nid", "rank", F.round("d", 5).alias("d"))


@query(f"""WITH {NEAR_SQL}, n AS (SELECT (SELECT count(*) FROM m) AS own, (SELECT count(*) FROM embeddings) - 2 * (SELECT count(*) FROM m) AS wanted
), e AS (SELECT id, v, wanted // own + (row_number() OVER (ORDER BY {u("more", "id")}, id) <= wanted % own)::INT AS times FROM m, n
), s AS (SELECT id, v, unnest(range(times)) AS nth FROM e
), p AS (SELECT s.*, {u("step", "concat_ws(':', id, nth)")} AS step, floor((SELECT max(rank) FROM near) * {u("pick", "concat_ws(':', id, nth)")}) + 1 AS pick FROM s)
SELECT p.id, nth::INT AS nth, list_transform(range(1, len(p.v) + 1), lambda i: round(p.v[i] + step * (b.v[i] - p.v[i]), 5)) AS px
FROM p JOIN near ON near.id = p.id AND near.rank = p.pick JOIN m b ON b.id = near.nid""")
def smp2_smote(spark: SparkSession, d: str) -> DataFrame:
    """As many synthetic rows of the smaller class as balance it."""
    return sampling.smote(minority(spark, d), "px").select("id", "nth", F.transform("px", lambda v: C.half_away(v, 5)).alias("px"))


@query(f"""WITH x AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, (embedding[1]::DOUBLE + embedding[2]::DOUBLE > 0)::INT AS label, vec_id % 23 AS city_id FROM embeddings
), g AS (SELECT DISTINCT city_id FROM x WHERE label = 1
), t AS (SELECT city_id FROM (SELECT city_id, row_number() OVER (ORDER BY {u("splitg", "city_id")}, city_id) AS r FROM g), (SELECT floor(count(*) * 0.2::DOUBLE) AS k FROM g) WHERE r <= k
), s AS (SELECT *, city_id IN (SELECT city_id FROM t) AS test FROM x
), n AS (SELECT label, count(*) AS n FROM s WHERE NOT test GROUP BY label
), k AS (SELECT (SELECT label FROM n ORDER BY n, -label LIMIT 1) AS small, (SELECT min(n) FROM n) AS few, (SELECT max(n) FROM n) AS many
), r AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {u("s", "id")}, id) AS nth FROM s WHERE NOT test
), p AS (SELECT 'train' AS part, label, a FROM r, k WHERE label = small OR nth <= least(many, floor(few / 0.8::DOUBLE)) UNION ALL SELECT 'test', label, a FROM s WHERE test
), z AS (SELECT avg(a) AS m, stddev_pop(a) AS d FROM p WHERE part = 'train')
SELECT part, label, count(*) AS n, round(avg((a - m) / d), 6) AS mean FROM p, z GROUP BY part, label""")
def smp8_prepared(spark: SparkSession, d: str) -> DataFrame:
    """Split by groups, resample, scale: the whole preparation, summed up."""
    x = sampling.group_split(labelled(spark, d), label="label")
    train = sampling.under_sample(x.where("part = 'train'"), ratio=0.8)
    scaler = features.fit_scaler(train, "px")
    both = features.apply_scaler(train.unionByName(x.where("part = 'test'")), scaler, "px")
    features.check_same_columns(train, both)
    return both.groupBy("part", "label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("px")[0]), 6).alias("mean"))


# Trees are small here: five rounds of three levels. The numbers of fits are those of the real jobs.
SMALL = boosting.Settings(rounds=5, bins=16)
# Parts of a vector that stand for groups of features, by first and last place.
GROUPS = {"C": (0, 32), "D": (32, 60), "A": (60, 64), "C+D": (0, 60), "all": (0, 64)}


@query()
def mdl1_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Classifiers of five groups of features, fitted together, positives weighed up; metrics of each by part."""
    x = stored(sampling.row_split(labelled(spark, d)), "labelled")
    train = x.where("part = 'train'")
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    allowed = np.zeros((len(GROUPS), 64), bool)
    for i, (a, b) in enumerate(GROUPS.values()):
        allowed[i, a:b] = True
    fits = boosting.Fits(len(GROUPS), allowed, np.zeros(len(GROUPS), int), positive=np.full(len(GROUPS), n[0] / n[1]), settings=SMALL)
    rows = lambda df: df.select(F.lit(0).alias("g"), "id", F.col("px").alias("v"), F.array(F.col("label").cast("double")).alias("y"), F.array(F.lit(1).cast("tinyint")).alias("w"), "label", "part")
    p = boosting.score(rows(x), boosting.fit(rows(train), fits), keep=("label", "part"))
    p = stored(p.withColumn("features", F.get(F.array(*map(F.lit, GROUPS)), F.col("fit"))).withColumn("pred", (F.col("score") > 0.5).cast("int")), "scores")
    by = ["features", "part"]
    return metrics.rates(metrics.confusion(p, "label", "pred", by=by)).join(metrics.areas(metrics.curve(p, "label", "score", by=by), by), by)


_stores: dict[tuple[str, str], str] = {}


def model_store_of(spark: SparkSession, d: str) -> tuple[model_store.ModelStore, DataFrame]:
    """300 bootstrap models in a store, fitted by the first query that asks for them, and the rows they were fitted on."""
    x = features.expand(labelled(spark, d), "px", "D", 64)
    path = _stores.setdefault((spark.sparkContext.applicationId, d), scratch(spark, "models"))
    store = model_store.ModelStore(spark, path)
    store.train(x, [f"D{i}" for i in range(64)], 300, ratio=0.5, settings=SMALL)
    return store, x


@query()
def mdl4_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """300 bootstrap models' mean probability of each row, and its deviation."""
    store, x = model_store_of(spark, d)
    return store.predict(x)[0].groupBy("id").agg(F.count("*").alias("models"), F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"))


@query()
def mdl5_ensemble_inference(spark: SparkSession, d: str) -> DataFrame:
    """What each stored model says of all rows: by its own scaler, in one scan for all models."""
    store, x = model_store_of(spark, d)
    return store.predict(x)[0].groupBy("model_id").agg(F.count("*").alias("n"), F.min("prob").alias("low"), F.max("prob").alias("high"))


@query()
def snk5_stored_model(spark: SparkSession, d: str) -> DataFrame:
    """Stored models: state, order of features and scaler of each, and how often they are right on columns in another order."""
    store, x = model_store_of(spark, d)
    p = store.predict(x.select(*reversed(x.columns)))[0].join(x.select("id", "label"), "id")
    right = p.groupBy("model_id").agg(F.avg(((F.col("prob") > 0.5).cast("int") == F.col("label")).cast("int")).alias("accuracy"))
    rows = store.rows().select("model_id", "seed", "state", F.size("features").alias("features"), F.get("features", F.lit(1)).alias("second"), F.get("means", F.lit(1)).alias("mean"), F.get("stds", F.lit(1)).alias("std"))
    return rows.join(right, "model_id")


def experiment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Eligible cells of each window of 300 years at steps of 50, with 80 repeats' membership."""
    c = X.cells(spark, d)
    windows = timeline.windows_with_min(c, timeline.hopping_windows(c, "birth"), "birth", 5)
    return experiments.membership(experiments.in_windows(c, windows), 80, ratio=0.5)


@query(f"""WITH {CELLS}, b AS (SELECT min(birth) AS a, max(birth) AS b FROM cells
), w AS (SELECT start, start + 300 AS "end" FROM (SELECT unnest(generate_series(a, b - 300, 50)) AS start FROM b) WHERE (SELECT count(*) FROM cells WHERE birth >= start AND birth < start + 300) >= 5
), e AS (SELECT start, id, city_id, CASE WHEN is_city = 1 AND birth > "end" THEN 0 ELSE is_city END AS y FROM cells, w WHERE NOT coalesce(birth < start AND is_city = 1, false)
), r AS (SELECT range AS r FROM range(80)
), g AS (SELECT DISTINCT start, city_id FROM e WHERE y = 1 AND city_id > -1
), t AS (SELECT start, r, city_id FROM (SELECT *, row_number() OVER (PARTITION BY start, r ORDER BY {u("='group' || start || '_' || r || '_'", "city_id")}, city_id) AS nth, count(*) OVER (PARTITION BY start, r) AS n FROM g, r) WHERE nth <= floor(n * 0.2::DOUBLE)
), p AS (SELECT e.start, r.r, e.id, e.y, CASE WHEN e.city_id > -1 THEN t.city_id IS NOT NULL ELSE {u("='row' || e.start || '_' || r.r || '_'", "e.id")} < 0.2 END AS test FROM e CROSS JOIN r LEFT JOIN t ON t.start = e.start AND t.r = r.r AND t.city_id = e.city_id
), n AS (SELECT start, r, test, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM p GROUP BY ALL
), s AS (SELECT p.*, y = 1 OR {u("='draw' || p.start || '_' || p.r || '_'", "p.id")} < least(1.0::DOUBLE, coalesce(floor(pos / 0.5::DOUBLE) / nullif(neg, 0)::DOUBLE, 0)) AS stay FROM p JOIN n USING (start, r, test))
SELECT start, r::INT AS repeat, test, count(*) FILTER (stay) AS drawn, count(*) FILTER (stay AND y = 1) AS positives, sum(id) FILTER (stay)::BIGINT AS ids FROM s GROUP BY start, r, test HAVING count(*) FILTER (stay) > 0""")
def mdl6_membership(spark: SparkSession, d: str) -> DataFrame:
    """How many rows, and which, are fitted on and tested in each window and repeat."""
    x = experiment_rows(spark, d).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(79))))
    hit = F.when(experiments.bit("tested", F.col("repeat")), True).when(experiments.bit("train", F.col("repeat")), False)
    x = x.withColumn("test", hit).where("test is not null")
    return x.groupBy("start", "repeat", "test").agg(F.count("*").alias("drawn"), F.count_if(F.col("label") == 1).alias("positives"), F.sum("id").alias("ids"))


@query()
def mdl6_window_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Scores of 80 repeats in each window, with and without the counts of neighbouring towns.

    Counts are those of the first founding year within or after the window's start. A cell's own founding year tells
    whether it is a town, so it is never a feature.
    """
    towns = X.cities(spark, d)
    x = stored(experiment_rows(spark, d), "members")
    asked = timeline.asof_forward(x.select("start").distinct(), towns, "start", "birth")
    counts = spatial.neighbour_counts(X.cells(spark, d), towns).withColumnRenamed("year", "matched")
    near = counts.join(asked.select("start", "matched"), "matched").drop("matched")
    bands = ["n_20", "n_50", "n_100"]
    rows = x.join(near, ["start", "id"], "left").na.fill(0, bands)
    found = experiments.window_experiment(rows, ["elevation", "x", "y"], bands, 80, boosting.Settings(rounds=5, depth=2))
    return found.withColumn("end", F.col("start") + 300)


@query()
def mdl7_probes(spark: SparkSession, d: str) -> DataFrame:
    """Probes of 3 binary and 14 continuous targets, fitted together: ROC-AUC or R2 of each by part."""
    px = lambda i: F.col("px")[i]
    yes = [(px(k) + px(k + 1) > 0).cast("double") for k in (0, 2, 4)]
    x = sampling.row_split(labelled(spark, d)).withColumn("y", F.array(*yes, *[3 * px(k) - px(k + 1) + px(k) * px(k + 2) for k in range(14)]))
    x = stored(x.select(F.lit(0).alias("g"), "id", F.col("px").alias("v"), "y", F.array(F.lit(1).cast("tinyint")).alias("w"), "part"), "targets")
    fits = boosting.Fits(17, np.ones((17, 64), bool), np.zeros(17, int), squared=np.arange(17) > 2, settings=SMALL)
    p = boosting.score(x, boosting.fit(x.where("part = 'train'"), fits), keep=("y", "part"))
    p = stored(p.select(F.col("fit").alias("target"), "part", F.get("y", F.col("fit")).alias("y"), "score"), "probes")
    by = ["target", "part"]
    roc = metrics.areas(metrics.curve(p.where("target < 3"), "y", "score", by=by), by).select(*by, "roc_auc")
    return metrics.r2(p.where("target >= 3"), "y", "score", by).join(roc, by, "full")


def standardised(spark: SparkSession, d: str) -> DataFrame:
    x = X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px"))
    return features.apply_scaler(x, features.fit_scaler(x, "px"), "px")


@query()
def srt5_best_start(spark: SparkSession, d: str) -> DataFrame:
    """Each of 20 starts' cost for 18 clusters, and whether it is the one that is kept."""
    return clustering.kmeans(standardised(spark, d), "px")[1].select("seed", "sse", "kept")


@query()
def mdl8_best_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Rows in each of 18 clusters of the best of 20 starts, and its cost."""
    found, costs = clustering.kmeans(standardised(spark, d), "px")
    return found.groupBy("cluster").agg(F.count("*").alias("n")).crossJoin(costs.where("kept").select(F.col("sse").alias("cost")))


@query()
def mdl9_cluster_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of cost and silhouette of 200 starts for each of 2 to 30 clusters."""
    return clustering.sweep_summary(clustering.sweep(standardised(spark, d), "px"))


@query(f"""WITH p AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) AS i FROM embeddings
), s AS (SELECT i, avg(p) AS m, stddev_pop(p) AS s FROM p GROUP BY i
), z AS (SELECT id, list((p - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS v FROM p JOIN s USING (i) GROUP BY id
), c AS (SELECT * FROM (SELECT seed::INT AS seed, v, row_number() OVER (PARTITION BY seed ORDER BY {u("='init' || seed || '_'", "id")}, id) - 1 AS cluster FROM z, range(20) r(seed)) WHERE cluster < 18
), a AS (SELECT seed, id, min(list_distance(z.v, c.v)) AS d, arg_min(cluster, (list_distance(z.v, c.v), cluster)) AS cluster FROM z, c GROUP BY seed, id)
SELECT seed, cluster::INT AS cluster, count(*) AS n, round(sum(d * d), 4) AS sse, round(avg(v[1]), 5) AS first, round(avg(list_sum(v)), 5) AS total FROM a JOIN z USING (id) GROUP BY seed, cluster""")
def mdl9_first_step(spark: SparkSession, d: str) -> DataFrame:
    """One step of 20 fits of 18 clusters from their starting rows: members, cost and new centre of each cluster."""
    x = clustering.Fits(standardised(spark, d), "px", [(18, s) for s in range(20)]).clusters().where("n > 0")
    total = F.aggregate("mean", F.lit(0.0), lambda s, v: s + v)
    return x.select("seed", "cluster", "n", F.round("sse", 4).alias("sse"), F.round(F.col("mean")[0], 5).alias("first"), F.round(total, 5).alias("total"))


@query("""WITH e AS (SELECT vec_id AS id, list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (4.0::DOUBLE * i / 127 - 1)) AS a, list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * ((4.0::DOUBLE * i + 2) / 127 - 1)) AS b FROM embeddings)
SELECT id, [round(list_sum(a), 5), round(list_sum(b), 5)] AS embedding FROM e""")
def mdl11_batch_embedding(spark: SparkSession, d: str) -> DataFrame:
    """A user's function over all tiles, in batches: here a projection."""

    def project(batch: np.ndarray) -> np.ndarray:
        return batch.astype("float64") @ np.linspace(-1, 1, batch.shape[1] * 2).reshape(batch.shape[1], 2)

    return models.embed(X.tiles(spark, d), "px", project, kind="double").withColumn("embedding", F.transform("embedding", lambda v: F.round(v, 5)))


@query(f"""WITH {LINES}, c AS (SELECT flag, count(*) FILTER (label = 0 AND score <= 0.05) AS tn, count(*) FILTER (label = 0 AND score > 0.05) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.05) AS fn, count(*) FILTER (label = 1 AND score > 0.05) AS tp FROM lines GROUP BY flag
), r AS (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS "precision", tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1,
  coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c)
SELECT flag, tn, fp, fn, tp, round(f1, 6) AS f1, round(mcc, 6) AS mcc, 'flag ' || flag || ': rows ' || (tn + fp + fn + tp) || ', accuracy ' || coalesce(printf('%.4f', accuracy), 'none') || ', precision ' || coalesce(printf('%.4f', "precision"), 'none')
  || ', recall ' || coalesce(printf('%.4f', recall), 'none') || ', f1 ' || coalesce(printf('%.4f', f1), 'none') || ', mcc ' || coalesce(printf('%.4f', mcc), 'none') AS report FROM r""")
def snk4_metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """Metrics written as CSV, as JSON and in words; the last two read back."""
    path = scratch(spark, "report")
    x = X.labelled_lines(spark, d).withColumn("pred", (F.col("score") > 0.05).cast("int"))
    tables.write_report(metrics.rates(metrics.confusion(x, "label", "pred", by=["flag"])), path, ["flag"])
    detail = spark.read.schema("flag string, confusion_matrix array<array<long>>, f1 double, mcc double").json(f"{path}/detail")
    cells = [F.col("confusion_matrix")[i][j].alias(c) for c, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    report = spark.read.text(f"{path}/report").select(F.regexp_extract("value", "^flag (.*?): ", 1).alias("flag"), F.col("value").alias("report"))
    return detail.select("flag", *cells, F.round("f1", 6).alias("f1"), F.round("mcc", 6).alias("mcc")).join(report, "flag")
