"""Classification metrics, curves and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import sampling
from ..sources import fixtures as X
from .registry import query
from .sql import LINES, TILES, u


def rounded(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


CONF = """c AS (SELECT flag, count(*) FILTER (label = 0 AND score <= 0.05) AS tn, count(*) FILTER (label = 0 AND score > 0.05) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.05) AS fn, count(*) FILTER (label = 1 AND score > 0.05) AS tp FROM lines GROUP BY flag)"""


def _confused(spark: SparkSession, d: str) -> DataFrame:
    x = X.labelled_lines(spark, d).withColumn("pred", (F.col("score") > 0.05).cast("int"))
    return M.confusion(x, "label", "pred", by=["flag"])


@query(f"""WITH {LINES}, {CONF} SELECT flag, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1,
  round(coalesce((tp * tn - fp * fn)::DOUBLE / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")
def agg18_confusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.rates(_confused(spark, d)), ["accuracy", "precision", "recall", "f1", "mcc"])


@query(f"""WITH {LINES}, {CONF}, b AS (SELECT flag, 1 AS label, tp AS hit, fp AS "false", fn AS missed FROM c UNION ALL SELECT flag, 0, tn, fn, fp FROM c)
SELECT flag, label, round(hit / nullif(hit + "false", 0)::DOUBLE, 6) AS precision, round(hit / nullif(hit + missed, 0)::DOUBLE, 6) AS recall,
  round(2 * hit / nullif(2 * hit + "false" + missed, 0)::DOUBLE, 6) AS f1, hit + missed AS support FROM b""")
def mdl3_class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.class_report(_confused(spark, d)), ["precision", "recall", "f1"])


def areas_sql(source: str, by: str = "") -> str:
    g, p, w = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"""g AS (SELECT {g}score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {source} GROUP BY {g}score
), r AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER ({p.strip()}) AS all_pos, sum(neg) OVER ({p.strip()}) AS all_neg FROM g
  WINDOW o AS ({p}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), q AS (SELECT *, tp / (tp + fp) AS here, coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1) AS before FROM r
), a AS (SELECT {g}round(sum(pos / nullif(all_pos, 0) * (here + before) / 2), 6) AS pr_auc, round(sum(pos / nullif(all_pos, 0) * here), 6) AS average_precision,
  round(sum(neg / nullif(all_neg, 0) * (2 * tp - pos) / nullif(2 * all_pos, 0)), 6) AS roc_auc FROM q {w})"""


@query(f"WITH {LINES}, {areas_sql('lines')} SELECT pr_auc FROM a")
def win1_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.areas(M.curve(X.labelled_lines(spark, d), "label", "score")), ["pr_auc"]).select("pr_auc")


@query(f"WITH {LINES}, {areas_sql('lines')} SELECT average_precision FROM a")
def win2_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.areas(M.curve(X.labelled_lines(spark, d), "label", "score")), ["average_precision"]).select("average_precision")


@query(f"WITH {LINES}, {areas_sql('lines', 'flag')} SELECT flag, roc_auc FROM a")
def win3_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    x = M.areas(M.curve(X.labelled_lines(spark, d), "label", "score", by=["flag"]), ["flag"])
    return rounded(x, ["roc_auc"]).select("flag", "roc_auc")


@query(f"""WITH {LINES}, g AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM lines GROUP BY score)
SELECT score, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def win1_curve_points(spark: SparkSession, d: str) -> DataFrame:
    return M.curve(X.labelled_lines(spark, d), "label", "score").select("score", "tp", "fp")


@query(f"WITH {LINES} SELECT flag, round(1 - sum((tax - score) ** 2) / (var_pop(tax) * count(tax)), 6) AS r2 FROM lines GROUP BY flag")
def agg20_r2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.r2(X.labelled_lines(spark, d), "tax", "score", ["flag"]), ["r2"])


@query(f"""WITH {TILES} SELECT label, round(avg(abs(list_sum(list_transform(px[1:32], lambda v: v::DOUBLE)))), 6) AS climate,
  round(avg(abs(list_sum(list_transform(px[33:60], lambda v: v::DOUBLE)))), 6) AS terrain, round(avg(abs(list_sum(list_transform(px[61:64], lambda v: v::DOUBLE)))), 6) AS agri FROM tiles GROUP BY label""")
def agg19_group_attribution(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d).select("label", F.slice("px", 1, 32).alias("c"), F.slice("px", 33, 28).alias("t"), F.slice("px", 61, 4).alias("a"))
    return rounded(M.group_attribution(t, {"climate": "c", "terrain": "t", "agri": "a"}, by=["label"]), ["climate", "terrain", "agri"])


REPS = 20
BOOT = f"""s AS (SELECT vec_id AS id, (label = 6)::INT AS label, (embedding[1]::DOUBLE + 1) / 2 AS score FROM embeddings
), x AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY id) - 1)::BIGINT AS ix, count(*) OVER (PARTITION BY label) AS n FROM s
), w AS (SELECT rep, label, floor(n * {u("='b' || rep || '_' || label || '_'", "draw")})::BIGINT AS ix, count(*) AS weight
  FROM (SELECT label, n, unnest(range(n)) AS draw FROM (SELECT DISTINCT label, n FROM x)), range({REPS}) r(rep) GROUP BY ALL
), m AS (SELECT rep, count(*) AS rows, sum(weight)::DOUBLE AS n, sum(weight) FILTER (label = 1 AND score > 0.5)::DOUBLE AS tp, sum(weight) FILTER (label = 0 AND score > 0.5)::DOUBLE AS fp,
  sum(weight) FILTER (label = 1 AND score <= 0.5)::DOUBLE AS fn FROM w JOIN x USING (label, ix) GROUP BY rep
), f AS (SELECT rep, coalesce(2 * coalesce(tp, 0) / nullif(2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0), 0)) AS f1, n FROM m)"""


def _replicates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    e = X.tiles(spark, d).select("id", (F.col("label") == 6).cast("int").alias("label"), ((F.col("px")[0].cast("double") + 1) / 2).alias("score"))
    # The fixture's numbering within its class; operators take any numbering from 0.
    x = e.withColumn("ix", (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("long"))
    return x, sampling.bootstrap_weights(x, REPS, by="label")


@query(f"WITH {BOOT} SELECT rep::INT AS rep, label, ix, weight FROM w")
def smp6_stratified_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _replicates(spark, d)[1].select("rep", "label", "ix", "weight")


@query(f"WITH {BOOT} SELECT round(avg(f1), 6) AS f1_mean, round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high FROM f")
def agg10_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    x, w = _replicates(spark, d)
    drawn = w.join(x.withColumn("pred", (F.col("score") > 0.5).cast("int")), ["label", "ix"])
    m = M.rates(M.confusion(drawn, "label", "pred", "weight", ["rep"]))
    return rounded(M.percentile_ci(m, ["f1"]), ["f1_mean", "f1_low", "f1_high"])


@query(f"""WITH {BOOT}, d AS (SELECT rep, score, label, weight FROM w JOIN x USING (label, ix)
), g AS (SELECT rep, score, sum(label * weight)::DOUBLE AS pos, sum((1 - label) * weight)::DOUBLE AS neg FROM d GROUP BY rep, score
), r AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY rep) AS all_pos FROM g WINDOW o AS (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), q AS (SELECT rep, sum(pos / all_pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1)) / 2) AS pr_auc FROM r GROUP BY rep)
SELECT round(avg(pr_auc), 5) AS pr_auc_mean, round(quantile_cont(pr_auc, 0.025), 5) AS pr_auc_low, round(quantile_cont(pr_auc, 0.975), 5) AS pr_auc_high FROM q""")
def mdl2_bootstrap_curves(spark: SparkSession, d: str) -> DataFrame:
    """All replicates' curves in one job."""
    x, w = _replicates(spark, d)
    a = M.areas(M.curve(w.join(x, ["label", "ix"]), "label", "score", "weight", ["rep"]), ["rep"])
    return rounded(M.percentile_ci(a, ["pr_auc"]), ["pr_auc_mean", "pr_auc_low", "pr_auc_high"], 5)


@query(f"""WITH {TILES}, p AS (SELECT a.id, a.label AS own, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.px, b.px), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS d
  FROM tiles a JOIN tiles b ON a.id <> b.id), m AS (SELECT id, own, other, avg(d) AS d FROM p GROUP BY ALL
), s AS (SELECT id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY id)
SELECT count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s""")
def mdl10_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.silhouette(X.tiles(spark, d)), ["silhouette"])


@query(f"""WITH {TILES}, m AS (SELECT label, i, avg(p) AS p FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(px)::DOUBLE AS p FROM tiles WHERE label IS NOT NULL) GROUP BY ALL
), c AS (SELECT label AS other, list(p ORDER BY i) AS c FROM m GROUP BY label
), d AS (SELECT id, label, other, sqrt(list_sum(list_transform(list_zip(px, c), lambda z: (z[1]::DOUBLE - z[2]) ** 2))) AS d FROM tiles, c WHERE label IS NOT NULL
), s AS (SELECT id, label, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY id, label)
SELECT label, count(*) AS n, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s GROUP BY label""")
def mdl10_simplified_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """The silhouette by distances to centres, for whole tables."""
    return rounded(M.simplified_silhouette(X.tiles(spark, d)), ["silhouette"])
