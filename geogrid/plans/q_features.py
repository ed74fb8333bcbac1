"""Scans, column operators, joins of feature families, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as T
from ..operators import timeline
from ..operators.storage import stored
from ..sources import fixtures as X
from ..sources import tables as S
from .registry import query
from .sql import CELLS, CITIES, TILES


@query(f"WITH {CELLS} SELECT id, is_city, birth, city_id, round(x, 6) AS x FROM cells")
def src1_feature_table(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(spark, d).select("id", "is_city", "birth", "city_id", F.round("x", 6).alias("x"))


@query("SELECT vec_id AS id, embedding[1]::DOUBLE AS D0, embedding[2]::DOUBLE AS D1, embedding[64]::DOUBLE AS D63 FROM embeddings")
def src2_expanded_embedding(spark: SparkSession, d: str) -> DataFrame:
    wide = T.expand(X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px")), "px", "D", 64)
    return wide.select("id", "D0", "D1", "D63")


@query("SELECT vec_id AS id, list_sum(embedding::DOUBLE[]) > 0 AS positive, embedding[5]::DOUBLE AS fifth FROM embeddings")
def src2_packed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Columns packed into an array again give the array they came from."""
    wide = T.expand(X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px")), "px", "D", 64)
    p = T.pack(wide, "D", "px")
    return p.select("id", (F.aggregate("px", F.lit(0.0), lambda a, v: a + v) > 0).alias("positive"), F.get("px", F.lit(4)).alias("fifth"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def src3_csv_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read back with its schema."""
    from ..operators.storage import scratch

    path = scratch(spark, "csv")
    X.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    return S.read_csv(spark, path, "id long, name string, balance double")


@query("SELECT (1000 + p_size * 10)::BIGINT AS year, p_partkey AS id FROM part WHERE p_partkey % 3 <> 0")
def scl7_tile_names(spark: SparkSession, d: str) -> DataFrame:
    """Year and id out of tile names; every third name is of another kind."""
    p = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("/tiles/Y"), (1000 + F.col("p_size") * 10).cast("string"), F.lit("_"), p, F.when(F.col("p_partkey") % 3 == 0, ".png").otherwise(".tiff"))
    x = X.table(spark, d, "part").select(name.alias("path"))
    return x.select(*S.parse_tile_name("path")).where("year is not null")


@query("SELECT p_partkey AS id, replace(replace(replace(p_type || '|?*', '|', '-'), '?', '-'), '*', '-') AS name FROM part")
def scl7_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.safe_name(F.concat("p_type", F.lit("|?*"))).alias("name"))


@query("SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, 10.0 + 0.5 * (p_partkey % 50) AS x, 60.0 - 0.5 * (p_partkey // 50) AS y FROM part")
def src5_raster_scan(spark: SparkSession, d: str) -> DataFrame:
    px = X.pixels(spark, d).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    return px.select("row", "col", (10.0 + 0.5 * F.col("col")).alias("x"), (60.0 - 0.5 * F.col("row")).alias("y"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src6_grid_names(spark: SparkSession, d: str) -> DataFrame:
    n = X.table(spark, d, "nation")
    return T.standard_names(n, {"n_nationkey": "id", "n_name": "name"}).select("id", "name")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def src8_pruned_partition(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned table read for one key."""
    from ..operators.storage import scratch

    path = scratch(spark, "partitioned")
    X.table(spark, d, "events").select("event_id", "value", "event_type").write.partitionBy("event_type").parquet(path)
    return S.partitioned(spark, path, event_type="purchase").select("event_id", "value")


@query("""SELECT event_type AS "group", count(*) AS n FROM events GROUP BY 1""")
def flt4_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return stored(X.table(spark, d, "events").select("event_type"), "events").groupBy(F.col("event_type").alias("group")).agg(F.count("*").alias("n"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """A wide feature table: id, labels, D0..D3, C0..C1, distances."""
    e = F.col("embedding")
    x = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("city_id"), *[e[i].cast("double").alias(f"D{i}") for i in range(4)], *[e[4 + i].cast("double").alias(f"C{i}") for i in range(2)])
    return x.withColumn("d_river", F.abs("D0") * 5000).withColumn("d_road", F.abs("D1")).withColumn("city_count_20km", F.col("city_id") * 2)


@query("""SELECT vec_id AS id, embedding[1]::DOUBLE AS D0, embedding[2]::DOUBLE AS D1, embedding[3]::DOUBLE AS D2, embedding[4]::DOUBLE AS D3,
  embedding[5]::DOUBLE AS C0, embedding[6]::DOUBLE AS C1 FROM embeddings""")
def prj1_feature_groups(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    g = T.groups(w, {"terrain": "D", "climate": "C"}, {"water": ["d_river"]}, skip=["d_road", "d_hub"])
    return w.select("id", *g["terrain"], *g["climate"])


@query("SELECT embedding[5]::DOUBLE AS C0, embedding[6]::DOUBLE AS C1, abs(embedding[1]::DOUBLE) * 5000 AS d_river FROM embeddings")
def prj2_sorted_matrix(spark: SparkSession, d: str) -> DataFrame:
    return T.matrix(wide(spark, d), ["id", "city_id", "D0", "D1", "D2", "D3", "d_road", "city_count_20km"])


@query("SELECT vec_id AS id, label AS city_id, abs(embedding[1]::DOUBLE) * 5000 AS d_river, abs(embedding[2]::DOUBLE) AS d_road, label * 2 AS city_count_20km FROM embeddings")
def prj3_dropped_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return T.drop_prefixed(wide(spark, d), "C", "D")


@query("""SELECT vec_id AS id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE, label * 2.0] AS with_towns,
  [embedding[5]::DOUBLE, embedding[6]::DOUBLE] AS climate FROM embeddings""")
def prj4_group_matrices(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    g = T.groups(w, {"terrain": "D", "climate": "C"}, {})
    return w.select("id", F.array(*g["terrain"], F.col("city_count_20km").cast("double")).alias("with_towns"), F.array(*g["climate"]).alias("climate"))


@query("SELECT vec_id AS id, abs(embedding[1]::DOUBLE) * 5000 AS d_river FROM embeddings")
def prj5_without_towns(spark: SparkSession, d: str) -> DataFrame:
    return T.drop_containing(wide(spark, d), "city_count_").select("id", "d_river")


@query(f"WITH {CELLS} SELECT id, elevation AS elevation_ssp1, round(lon, 6) AS lon_ssp1 FROM cells")
def prj6_scenario_suffix(spark: SparkSession, d: str) -> DataFrame:
    x = X.cells(spark, d).select("id", "elevation", F.round("lon", 6).alias("lon")).withColumn("Unnamed: 0", F.lit(0))
    return T.suffixed(x, "ssp1", ["elevation", "lon"])


@query(f"WITH {CITIES} SELECT city_id AS id, birth FROM cities")
def prj9_standard_names(spark: SparkSession, d: str) -> DataFrame:
    x = X.cities(spark, d).select(F.col("city_id").alias("cid"), F.col("birth").alias("BEG_YR"))
    return T.standard_names(x, {"cid": "id", "BEG_YR": "birth"})


@query(f"WITH {CELLS} SELECT id, coalesce((elevation < 2500)::INT, 0) AS near, nullif(city_id, -1) AS city FROM cells")
def flt7_near_and_sentinel(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(spark, d).select("id", C.near_flag("elevation").alias("near"), C.null_if("city_id", -1).alias("city"))


@query(f"WITH {CELLS} SELECT min(elevation) FILTER (elevation > 0) AS low, max(elevation) FILTER (elevation > 0) AS high FROM cells")
def flt8_positive_range(spark: SparkSession, d: str) -> DataFrame:
    return T.positive_range(X.cells(spark, d), "elevation")


@query(f"WITH {CELLS} SELECT id, country FROM cells WHERE country = 1")
def flt9_regular_cells(spark: SparkSession, d: str) -> DataFrame:
    """Regular cells of one country, from a table that also has surrogate cells for towns, numbered above the regular ones."""
    c = X.cells(spark, d).select("id", "country")
    last = c.agg(F.max("id")).first()[0] or 0
    towns = X.cities(spark, d).select((F.col("city_id") + last + 1).alias("id"), F.lit(1).alias("country"))
    return c.unionByName(towns).where((F.col("id") <= last) & (F.col("country") == 1))


@query(f"""WITH {CELLS} SELECT CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(x), 6) AS mean FROM cells GROUP BY 1""")
def prj8_same_columns(spark: SparkSession, d: str) -> DataFrame:
    """Train and test of the same columns, after columns that only one of them has were dropped where they exist."""
    c = X.cells(spark, d)
    train = T.drop_prefixed(c.where("id % 5 <> 0").withColumn("unused1", F.lit(0)), "unused")
    test = T.drop_prefixed(c.where("id % 5 = 0"), "unused")
    T.check_same_columns(train, test)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query(f"WITH {CELLS} SELECT id, CASE WHEN is_city = 1 THEN birth ELSE -1 END AS birth FROM cells")
def flt10_sentinel_birth(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(spark, d).select("id", F.when(F.col("is_city") == 1, F.col("birth")).otherwise(-1).alias("birth"))


@query(f"""WITH {CELLS} SELECT c.id, c.is_city, e.label, o.n FROM cells c JOIN embeddings e ON e.vec_id = c.id
  JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) o ON o.id = c.id""")
def jn1_feature_families(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return T.join_families(X.cells(spark, d).select("id", "is_city"), e, o)


@query(f"WITH {CELLS} SELECT c.id, c.country, e.label FROM cells c LEFT JOIN embeddings e ON e.vec_id = c.id AND e.label % 2 = c.country")
def jn2_composite_key(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("country"), "label")
    return T.join_families(X.cells(spark, d).select("id", "country"), e, on=["id", "country"], how="left")


@query("SELECT c_custkey AS id, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def jn8_dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    return T.lookup(c, X.table(spark, d, "nation"), "n_nationkey").select("id", F.col("n_name").alias("name"))


@query("SELECT c_custkey AS id, CASE WHEN r_name IS NULL THEN 'none' ELSE lower(r_name) END AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def scl8_code_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two code tables in turn: a class and its group."""
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    n = X.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    x = T.lookup(T.lookup(c, n, "n_nationkey"), X.table(spark, d, "region"), "r_regionkey")
    return x.select("id", F.lower(F.coalesce("r_name", F.lit("none"))).alias("region"))


@query(f"WITH {CELLS} SELECT id FROM cells WHERE id NOT IN (SELECT o_custkey FROM orders)")
def jn13_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return T.unmatched(X.cells(spark, d), X.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id").select("id")


@query("""SELECT 'buyer' AS region, c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT 'seller', s_suppkey, NULL FROM supplier""")
def set1_tagged_union(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return T.union_tagged({"buyer": c, "seller": X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))}).select("region", "id", "segment")


@query("SELECT label::BIGINT AS label FROM embeddings UNION SELECT n_regionkey::BIGINT FROM nation UNION SELECT 18::BIGINT")
def set2_key_domain(spark: SparkSession, d: str) -> DataFrame:
    a = X.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"))
    b = X.table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("label"))
    return a.union(b).union(spark.range(18, 19).toDF("label")).distinct()


@query(f"""WITH {TILES}, p AS (SELECT dim, avg(v) AS mean, stddev_pop(v) AS s FROM (SELECT unnest(px)::DOUBLE AS v, generate_subscripts(px, 1) - 1 AS dim FROM tiles) GROUP BY dim)
SELECT dim::INT AS dim, round(mean, 6) AS mean, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS std FROM p""")
def agg21_scaler(spark: SparkSession, d: str) -> DataFrame:
    p = T.fit_scaler(X.tiles(spark, d).select(F.col("px").cast("array<double>").alias("px")), "px")
    return p.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {TILES}, v AS (SELECT id, unnest(px)::DOUBLE AS v, generate_subscripts(px, 1) AS dim FROM tiles), p AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY dim)
SELECT id, round(max(z), 5) AS high, round(sum(z), 5) AS total FROM (SELECT id, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM v JOIN p USING (dim)) GROUP BY id""")
def scl12_scaled_rows(spark: SparkSession, d: str) -> DataFrame:
    t = X.tiles(spark, d).select("id", F.col("px").cast("array<double>").alias("px"))
    z = T.apply_scaler(t, T.fit_scaler(t, "px"), "px")
    return z.select("id", F.round(F.array_max("px"), 5).alias("high"), F.round(F.aggregate("px", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query(f"""WITH {CELLS}, v AS (UNPIVOT (SELECT birth::DOUBLE AS birth, elevation, lon FROM cells) ON birth, elevation, lon INTO NAME feature VALUE v),
  n AS (SELECT count(*) AS n FROM cells)
SELECT feature, n, n - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v, n GROUP BY feature, n""")
def agg15_feature_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = T.describe(X.cells(spark, d), ["birth", "elevation", "lon"])
    return x.select("feature", "n", "missing", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


@query(f"WITH {CELLS} SELECT is_city, count(*) AS n, count(DISTINCT city_id) AS n_groups FROM cells GROUP BY is_city")
def agg16_data_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.summary(X.cells(spark, d), "is_city", "city_id")


@query("SELECT vec_id AS id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS index FROM embeddings")
def win7_dense_index(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return T.dense_index(e, "label").select("id", "index")


@query("""SELECT c_nationkey AS nation, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS richest FROM customer GROUP BY 1""")
def win8_first_of_group(spark: SparkSession, d: str) -> DataFrame:
    c = X.table(spark, d, "customer")
    first = F.min_by("c_custkey", F.struct((-F.col("c_acctbal")).alias("a"), "c_custkey"))
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(first.alias("richest"))


@query("SELECT id, value, row_number() OVER (ORDER BY value DESC, id) - 1 AS nth FROM (SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_acctbal > 0)")
def srt2_draw_order(spark: SparkSession, d: str) -> DataFrame:
    """Values falling, missing ones left out, and each one's place in that order."""
    x = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"))
    x = x.where("value is not null").withColumn("o", F.struct(-F.col("value"), F.col("id")))
    return timeline.numbered(x, "o", "nth").select("id", "value", F.col("nth").cast("long").alias("nth"))


def _sink(spark: SparkSession, name: str) -> str:
    from ..operators.storage import scratch

    return scratch(spark, name)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk1_parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _sink(spark, "snk1")
    S.write(X.table(spark, d, "events").select("event_id", "event_type"), path)
    return S.read(spark, path, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag = 'R' AS has_2nd_nature, count(*) AS n, round(sum(l_tax), 4) AS total FROM lineitem GROUP BY 1")
def snk2_csv_by_flag(spark: SparkSession, d: str) -> DataFrame:
    path = _sink(spark, "snk2")
    x = X.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("has_2nd_nature"), "l_tax")
    S.write_results(x, path)
    back = S.read_csv(spark, path, "l_tax double, has_2nd_nature boolean")
    return back.groupBy("has_2nd_nature").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("total"))


@query("SELECT model_id::INT AS model_id, count(*) AS n FROM customer, range(4) m(model_id) GROUP BY 1")
def snk3_restarted_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two models are stored, a restart finds and adds the other two."""
    path = _sink(spark, "snk3")
    p = X.predictions(spark, d, 4).where("scenario = 'current'")
    S.append_predictions(p.where("model_id < 2"), path)
    S.append_predictions(p.where(F.col("model_id").isin(S.unfinished(spark, path, [0, 1, 2, 3]))), path)
    return spark.read.parquet(path).groupBy(F.col("model_id").cast("int").alias("model_id")).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, len(embedding) AS dims FROM embeddings")
def snk6_embedding_files(spark: SparkSession, d: str) -> DataFrame:
    path = _sink(spark, "snk6")
    S.write_embeddings(X.tiles(spark, d).select("id", "px"), path, 200)
    return spark.read.parquet(path).select("id", F.size("px").cast("long").alias("dims"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def scl13_json_results(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON objects and parsed again."""
    n = X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    text = n.select(F.to_json(F.struct("event_type", "n")).alias("j"))
    return text.select(F.from_json("j", "event_type string, n long").alias("r")).select("r.*")


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS year, o_custkey % 10 AS id FROM orders WHERE year(o_orderdate) < 1998")
def src4_tile_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Files of tiles in folders of years, and files of other names among them, found again by their names."""
    path, year = _sink(spark, "src4"), F.year("o_orderdate")
    name = F.concat(F.when(year < 1998, "Y").otherwise("X"), year.cast("string"), F.lit("_"), (F.col("o_custkey") % 10).cast("string"), F.lit(".tiff"))
    rows = X.table(spark, d, "orders").select(year.alias("folder"), name.alias("tile"), F.col("o_orderkey").cast("string").alias("value"))
    rows.repartition("folder", "tile").write.partitionBy("folder", "tile").text(path)
    # Spark names the files that it writes; the tiles, one file each, get theirs by renaming.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in spark.read.format("binaryFile").load(path).select("path").collect():
        at = jvm.org.apache.hadoop.fs.Path(r["path"])
        at.getFileSystem(conf).rename(at, jvm.org.apache.hadoop.fs.Path(at.getParent(), at.getParent().getName().split("=")[1]))
    return S.catalogue(spark, path).select("year", "id")
