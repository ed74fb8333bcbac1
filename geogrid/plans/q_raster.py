"""Rasters and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rng import uniform
from ..operators import ensemble, raster, tiles
from ..sources import fixtures as X
from .q_space import OVER_SQL, TOUCH, over
from .registry import query
from .sql import CLIMATE, CROPS, PIXELS, TILES, u


@query(f"WITH {PIXELS} SELECT key, value FROM pixels WHERE value >= -100")
def flt1_valid_pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.drop_nodata(X.pixels(spark, d)).select("key", "value")


@query("SELECT p_partkey AS key, (p_size = 32)::FLOAT AS mask FROM part")
def rst1_gap_mask(spark: SparkSession, d: str) -> DataFrame:
    x = X.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))
    return raster.gap_mask(x, F.lit(32)).select("key", "mask")


@query(f"""WITH {PIXELS}, t AS (SELECT row, col FROM pixels WHERE gap), s AS (SELECT row, col, value FROM pixels WHERE NOT gap AND value >= -100
), n AS (SELECT t.row, t.col, value, (t.row - s.row) ** 2 + (t.col - s.col) ** 2 AS d2,
  row_number() OVER (PARTITION BY t.row, t.col ORDER BY (t.row - s.row) ** 2 + (t.col - s.col) ** 2, s.row, s.col) AS r
  FROM t JOIN s ON s.row BETWEEN t.row - 12 AND t.row + 12 AND s.col BETWEEN t.col - 12 AND t.col + 12)
SELECT row, col, count(*) AS n, round(sum(value / d2) / sum(1 / d2), 5) AS filled FROM n WHERE r <= 5 GROUP BY row, col""")
def rst2_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return raster.idw_fill(X.pixels(spark, d)).select("row", "col", "n", F.round("filled", 5).alias("filled"))


@query(f"""WITH {CROPS}, p AS (SELECT crop, row, col, "yield" AS value, {u("='gap' || crop", "key")} < 0.1 AS gap FROM crop_yields WHERE crop <> 'c3' OR row % 3 = 0
), t AS (SELECT crop, row, col FROM p WHERE gap), s AS (SELECT crop, row, col, value FROM p WHERE NOT gap AND value >= -100
), n AS (SELECT crop, t.row, t.col, value, (t.row - s.row) ** 2 + (t.col - s.col) ** 2 AS d2,
  row_number() OVER (PARTITION BY crop, t.row, t.col ORDER BY (t.row - s.row) ** 2 + (t.col - s.col) ** 2, s.row, s.col) AS r
  FROM t JOIN s USING (crop) WHERE s.row BETWEEN t.row - 16 AND t.row + 16 AND s.col BETWEEN t.col - 16 AND t.col + 16)
SELECT crop, row, col, count(*) AS n, round(sum(value / d2) / sum(1 / d2), 5) AS filled FROM n WHERE r <= 5 GROUP BY crop, row, col""")
def rst2_folder_fill(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of three crops at once, each with its own gaps; of the third only every third row exists."""
    x = X.crop_yields(spark, d).where("crop <> 'c3' or row % 3 = 0")
    x = x.select("crop", "row", "col", F.col("yield").alias("value"), (uniform(F.concat(F.lit("gap"), "crop"), "key") < 0.1).alias("gap"))
    return raster.idw_fill(x, raster="crop").select("crop", "row", "col", "n", F.round("filled", 5).alias("filled"))


@query(f"""WITH {CROPS}, k(crop, kcal) AS (VALUES ('c1', 3.5::DOUBLE), ('c2', 1.25::DOUBLE)) SELECT key, crop, "yield" * kcal AS calories FROM crop_yields LEFT JOIN k USING (crop)""")
def rst3_calories(spark: SparkSession, d: str) -> DataFrame:
    k = spark.createDataFrame([("c1", 3.5), ("c2", 1.25)], "crop string, kcal double")
    return raster.to_calories(X.crop_yields(spark, d), k).select("key", "crop", "calories")


@query(f"""WITH {CROPS}, k(crop, kcal) AS (VALUES ('c1', 3.5::DOUBLE), ('c2', 1.25::DOUBLE), ('c3', 0.5::DOUBLE))
SELECT crop, count(*) AS n, round(sum("yield" * kcal), 3) AS calories FROM crop_yields JOIN k USING (crop) GROUP BY crop""")
def scl2_calories(spark: SparkSession, d: str) -> DataFrame:
    """Yield times calories, summed by crop."""
    k = spark.createDataFrame([("c1", 3.5), ("c2", 1.25), ("c3", 0.5)], "crop string, kcal double")
    x = raster.to_calories(X.crop_yields(spark, d), k)
    return x.groupBy("crop").agg(F.count("*").alias("n"), F.round(F.sum("calories"), 3).alias("calories"))


@query(f"""WITH {PIXELS}, t AS (SELECT row, col FROM pixels WHERE gap OR key % 10 = 0), s AS (SELECT row, col, value FROM pixels WHERE NOT gap AND value >= -100
), n AS (SELECT t.row, t.col, value, (t.row - s.row) ** 2 + (t.col - s.col) ** 2 AS d2,
  row_number() OVER (PARTITION BY t.row, t.col ORDER BY (t.row - s.row) ** 2 + (t.col - s.col) ** 2, s.row, s.col) AS r
  FROM t JOIN s ON s.row BETWEEN t.row - 12 AND t.row + 12 AND s.col BETWEEN t.col - 12 AND t.col + 12)
SELECT row, col, round(CASE WHEN min(d2) = 0 THEN max(value) FILTER (d2 = 0) ELSE sum(value / sqrt(d2)) FILTER (d2 > 0) / sum(1 / sqrt(d2)) FILTER (d2 > 0) END, 5) AS filled FROM n WHERE r <= 5 GROUP BY row, col""")
def scl3_inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    """Inverse distance of power 1 for gaps and for pixels that have a value, which is theirs exactly."""
    px = X.pixels(spark, d)
    again = px.where("gap or key % 10 = 0").withColumn("gap", F.lit(True)).unionByName(px.where("not gap"))
    return raster.idw_fill(again, power=1.0).select("row", "col", F.round("filled", 5).alias("filled"))


RANKS = [("c1", 1), ("c2", 2), ("c3", 3)]


@query(f"""WITH {CROPS} SELECT row, col, coalesce(arg_max(substr(crop, 2)::INT, ("yield", -substr(crop, 2)::INT)) FILTER ("yield" > 0), 0)::INT AS crop_rank,
  coalesce(max("yield") FILTER ("yield" > 0), -2) AS best FROM crop_yields GROUP BY row, col""")
def agg9_best_crop(spark: SparkSession, d: str) -> DataFrame:
    return raster.best_crop(X.crop_yields(spark, d), spark.createDataFrame(RANKS, "crop string, rank int"))


@query(f"""WITH {CROPS}, land AS (SELECT row, col, key % 3 AS continent FROM pixels WHERE key % 7 <> 0), native(continent, crop) AS (VALUES (0, 'c1'), (0, 'c2'), (1, 'c3'))
SELECT y.row, y.col, CASE WHEN bool_and(l.continent IS NULL) THEN -100 ELSE coalesce(arg_max(substr(y.crop, 2)::INT, ("yield", -substr(y.crop, 2)::INT)) FILTER ("yield" > 0 AND n.crop IS NOT NULL), 0) END::INT AS crop_rank,
  CASE WHEN bool_and(l.continent IS NULL) THEN -1 ELSE coalesce(max("yield") FILTER ("yield" > 0 AND n.crop IS NOT NULL), -2) END::DOUBLE AS best
FROM crop_yields y LEFT JOIN land l ON l.row = y.row AND l.col = y.col LEFT JOIN native n ON n.continent = l.continent AND n.crop = y.crop GROUP BY y.row, y.col""")
def rst5_native_best_crop(spark: SparkSession, d: str) -> DataFrame:
    land = X.pixels(spark, d).where("key % 7 <> 0").select("row", "col", (F.col("key") % 3).alias("continent"))
    lists = spark.createDataFrame([(0, "c1, c2", "-"), (1, "-", "c3"), (2, "-", "-")], "continent long, a string, b string")
    ranks = spark.createDataFrame(RANKS, "crop string, rank int")
    return raster.best_crop(X.crop_yields(spark, d), ranks, land, raster.native_crops(lists, ["a", "b"]))


@query("""SELECT DISTINCT c_mktsegment AS continent, trim(crop) AS crop FROM (SELECT c_mktsegment, unnest(string_split(concat_ws(',', n_name, '-', 'x' || n_regionkey), ',')) AS crop
FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE trim(crop) NOT IN ('-', '')""")
def jn9_crop_lists(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    lists = c.select(F.col("c_mktsegment").alias("continent"), F.col("n_name").alias("a"), F.lit("-").alias("b"), F.concat(F.lit("x"), F.col("n_regionkey").cast("string")).alias("c"))
    return raster.native_crops(lists.distinct(), ["a", "b", "c"])


@query(f"""WITH {PIXELS}, {OVER_SQL} SELECT o.id, count(value) AS n, round(coalesce(avg(value), -100), 5) AS mean
FROM over o LEFT JOIN (SELECT * FROM pixels WHERE value >= -100) ON {TOUCH} GROUP BY o.id""")
def agg1_zonal_mean(spark: SparkSession, d: str) -> DataFrame:
    z = raster.zonal_mean(X.pixels(spark, d).select("row", "col", "value"), over(spark, d), empty=-100.0)
    return z.select("id", "n", F.round("mean", 5).alias("mean"))


@query(f"""WITH {CLIMATE} SELECT scenario, model, row, col, (CASE WHEN model IN ('m1') THEN raw * 0.1::DOUBLE - 273.15::DOUBLE ELSE raw * 0.1::DOUBLE END)::FLOAT AS value FROM climate""")
def scl1_rescaled_climate(spark: SparkSession, d: str) -> DataFrame:
    x = X.climate(spark, d)
    return x.select("scenario", "model", "row", "col", C.rescaled(F.col("model"), F.col("raw"), ("m1",)).alias("value"))


@query(f"""WITH {CLIMATE} SELECT scenario, row, col, round(avg(raw), 6) AS mean, count(DISTINCT model) AS n,
  CASE WHEN count(DISTINCT model) = 5 THEN 'full' WHEN count(DISTINCT model) * 2 >= 5 THEN 'partial' ELSE 'poor' END AS coverage FROM climate GROUP BY ALL""")
def agg3_model_mean(spark: SparkSession, d: str) -> DataFrame:
    x = ensemble.model_mean(X.climate(spark, d).withColumnRenamed("raw", "value"), ["scenario", "row", "col"], 5)
    return x.select("scenario", "row", "col", F.round("mean", 6).alias("mean"), "n", "coverage")


@query(f"WITH {CLIMATE} SELECT s AS scenario, m AS model FROM (VALUES ('s1'), ('s2')) a(s), (VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m4')) b(m) WHERE (s, m) NOT IN (SELECT (scenario, model) FROM climate)")
def agg3_missing_models(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.missing_models(X.climate(spark, d), ["s1", "s2"], [f"m{i}" for i in range(5)])


@query(f"""WITH {PIXELS}, c AS (SELECT DISTINCT row // 10 * 5 + col // 10 AS id, row // 10 * 10 + (row // 10 + col // 10) % 7 AS row0, col // 10 * 10 + (col // 10) % 4 AS col0 FROM pixels)
SELECT id, count(*) AS n, round(sum(value * ((row - row0) * 8 + col - col0)), 4) AS moment FROM c JOIN pixels ON row >= row0 AND row < row0 + 10 AND col >= col0 AND col < col0 + 8 GROUP BY 1""")
def rst6_clipped_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 10 x 8 that begin anywhere on the raster; the moment depends on every pixel's place."""
    px = X.pixels(spark, d)
    ty, tx = F.floor(F.col("row") / 10), F.floor(F.col("col") / 10)
    cells = px.select((ty * 5 + tx).alias("id"), (ty * 10 + (ty + tx) % 7).alias("row0"), (tx * 10 + tx % 4).alias("col0")).distinct()
    t = raster.clip(px, cells, 10, 8)
    moment = F.aggregate(F.transform("px", lambda v, i: F.coalesce(v, F.lit(0.0)) * i), F.lit(0.0), lambda a, v: a + v)
    return t.select("id", F.size(F.filter("px", lambda v: v.isNotNull())).cast("long").alias("n"), F.round(moment, 4).alias("moment"))


@query(f"""WITH {PIXELS}, t AS (SELECT key, row // 10 * 5 + col // 10 AS id, value, (row // 10) % 2 = 0 AS bio FROM pixels
), m AS (SELECT *, avg(value) FILTER (value > -100) OVER (PARTITION BY id) AS mean FROM t)
SELECT key, round(CASE WHEN bio THEN CASE WHEN value < -100 THEN mean ELSE value END ELSE CASE WHEN value < -3000 THEN 0 ELSE value END END, 5) AS value FROM m WHERE NOT bio OR mean IS NOT NULL""")
def rst7_tile_nodata(spark: SparkSession, d: str) -> DataFrame:
    x = X.pixels(spark, d).select("key", (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).alias("id"), "value", (F.floor(F.col("row") / 10) % 2 == 0).alias("bio"))
    return raster.tile_nodata(x, F.col("bio")).select("key", F.round("value", 5).alias("value"))


@query("SELECT p_partkey AS key, CASE WHEN p_retailprice - 850 > 80 THEN 255 ELSE 0 END AS water FROM part")
def rst8_water_threshold(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("key"), raster.water(F.col("p_retailprice") - 850).alias("water"))


_WEIGHTS = ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in raster.bilinear_weights(8, 5))


@query(f"""WITH {TILES}, k(d, s, w) AS (VALUES {_WEIGHTS}), p AS (SELECT id, (generate_subscripts(px, 1) - 1) // 8 AS row, (generate_subscripts(px, 1) - 1) % 8 AS col, unnest(px)::DOUBLE AS v FROM tiles
), c AS (SELECT id, row, d AS col, sum(w * v) AS v FROM p JOIN k ON s = col GROUP BY id, row, d)
SELECT id, d::INT AS row, col::INT AS col, round(sum(w * v), 6) AS value FROM c JOIN k ON s = row GROUP BY id, d, col""")
def rst9_resized_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = X.tiles(spark, d).select("id", F.posexplode("px").alias("i", "v"))
    p = p.select("id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("v").cast("double").alias("value"))
    return raster.resize(p, 8, 5).select("id", "row", "col", F.round("value", 6).alias("value"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    """Nine bands of an embedding's numbers for each; every 11th lacks its last band."""
    e = X.tiles(spark, d).select("id", F.lit(1500).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("b"), "px")
    return e.where("not (id % 11 = 0 and b = 9)").select("id", "year", F.concat(F.lit("b"), F.col("b").cast("string")).alias("band"), F.slice("px", F.col("b") * 4, F.lit(4)).alias("px"))


BANDS = [f"b{i}" for i in range(1, 10)]


@query(f"WITH {TILES} SELECT id, 9::BIGINT AS bands, px[36]::DOUBLE AS last FROM tiles WHERE id % 11 <> 0")
def rst10_stacked_bands(spark: SparkSession, d: str) -> DataFrame:
    full, _ = raster.stack(_bands(spark, d), BANDS)
    return full.select("id", F.size("px").cast("long").alias("bands"), F.col("px")[8][0].cast("double").alias("last"))


@query(f"WITH {TILES} SELECT id, 'b9' AS missing FROM tiles WHERE id % 11 = 0")
def rst10_missing_bands(spark: SparkSession, d: str) -> DataFrame:
    _, lacking = raster.stack(_bands(spark, d), BANDS)
    return lacking.select("id", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {TILES}, v AS (SELECT id, unnest(px)::DOUBLE AS v FROM tiles) SELECT id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM v GROUP BY id""")
def agg23_tile_statistics(spark: SparkSession, d: str) -> DataFrame:
    return tiles.stats(X.tiles(spark, d)).select("id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {TILES}, v AS (SELECT id, unnest(px)::DOUBLE AS v FROM tiles), s AS (SELECT id, avg(v) AS m, stddev_samp(v) AS s FROM v GROUP BY id
), z AS (SELECT id, max((v - m) / (s + 1e-6)) AS high, sum(abs((v - m) / (s + 1e-6))) AS total FROM v JOIN s USING (id) GROUP BY id
), w AS (SELECT id - 1 AS id, len(list_filter(px, lambda x: x > 0)) AS wet FROM tiles)
SELECT z.id, round(high, 5) AS high, round(total, 4) AS total, wet FROM z JOIN w USING (id)""")
def rst11_paired_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Each tile with the next one as its water."""
    t = X.tiles(spark, d).select("id", "px")
    p = tiles.pair(t, t.select((F.col("id") - 1).alias("id"), "px"))
    a, b = F.col("px")[0], F.col("px")[1]
    return p.select("id", F.round(F.array_max(a), 5).alias("high"), F.round(F.aggregate(F.transform(a, F.abs), F.lit(0.0), lambda x, v: x + v), 4).alias("total"), F.size(F.filter(b, lambda v: v > 0)).cast("long").alias("wet"))


@query(f"""WITH {TILES} SELECT id, round((list_max(px)::DOUBLE - 0.1) / 0.7, 6) AS high, list_sum(list_transform(px, lambda v: CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END))::DOUBLE AS balance FROM tiles""")
def scl11_normalised_channels(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px"))
    balance = F.aggregate(tiles.water_signs("px"), F.lit(0.0), lambda a, v: a + v)
    return t.select("id", F.round(F.array_max(tiles.channel_normalise("px", 0.1, 0.7)), 6).alias("high"), balance.alias("balance"))


@query(f"""WITH {TILES}, c AS (SELECT id, unnest(range(9)) AS b, px FROM tiles) SELECT id, round(sum(((px[b * 4 + 4] - 0.1 * b) / (1 + b))::DOUBLE), 4) AS total FROM c GROUP BY id""")
def rst12_nine_channels(spark: SparkSession, d: str) -> DataFrame:
    """Nine bands, each normalised by the constants of its own name, not of its place."""
    e = X.tiles(spark, d).select("id", F.lit(1500).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("b"), "px")
    e = e.select("id", "year", F.concat(F.lit("b"), F.col("b").cast("string")).alias("band"), F.slice("px", F.col("b") * 4, F.lit(1)).alias("px"))
    full, _ = raster.stack(e, BANDS)
    z = [tiles.channel_normalise(F.col("px")[i].cast("array<double>"), 0.1 * i, 1.0 + i)[0] for i in range(9)]
    return full.select("id", F.round(sum(z[1:], z[0]), 4).alias("total"))
