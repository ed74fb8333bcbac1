"""Spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import spatial
from ..sources import fixtures as X
from .registry import query
from .sql import CELLS, CITIES, PIXELS


@query(f"""WITH {CELLS}, {CITIES}, near AS (
  SELECT c.id, t.birth, t.end_yr, sqrt((c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y)) AS d FROM cells c JOIN cities t
  ON abs(c.x - t.x) <= 100 AND abs(c.y - t.y) <= 100 AND (c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y) <= 10000.0
), years AS (SELECT DISTINCT birth AS year FROM cities)
SELECT id, year, count(*) FILTER (d <= 20) AS n_20, count(*) FILTER (d <= 50) AS n_50, count(*) FILTER (d <= 100) AS n_100
FROM near JOIN years ON birth < year AND end_yr > year GROUP BY id, year""")
def jn4_within_distance(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbour_counts(X.cells(spark, d), X.cities(spark, d))


@query(f"""WITH {CELLS}, {CITIES} SELECT c.id, count(t.city_id) AS n FROM cells c LEFT JOIN cities t
  ON abs(c.x - t.x) <= 50 AND abs(c.y - t.y) <= 50 AND (c.x - t.x) * (c.x - t.x) + (c.y - t.y) * (c.y - t.y) <= 2500.0
  AND t.birth <= 1000 - 100 GROUP BY c.id""")
def agg2_neighbours_filled(spark: SparkSession, d: str) -> DataFrame:
    """Towns founded a century before the year 1000 within 50 km, zero where there is none."""
    cells = X.cells(spark, d)
    towns = X.cities(spark, d).where(C.exists_at(F.lit(1000), F.col("birth"), lag=100))
    near = spatial.within_distance(cells.select("id", "x", "y"), towns.select(F.col("city_id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by")), 50)
    n = near.groupBy("id").agg(F.count("*").alias("n"))
    return cells.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {CITIES} SELECT DISTINCT a.city_id, y.year FROM cities a, (SELECT DISTINCT birth AS year FROM cities) y
WHERE a.birth < y.year AND a.end_yr > y.year""")
def flt6_exists_at(spark: SparkSession, d: str) -> DataFrame:
    """Each town in every founding year that it lasts for; its years come from its own two, one by one."""
    towns = X.cities(spark, d)
    years = towns.select(F.col("birth").alias("year")).distinct()
    own = towns.where("end_yr > birth + 1").select("city_id", F.explode(F.sequence(F.col("birth") + 1, F.col("end_yr") - 1)).alias("year"))
    return own.join(years, "year").select("city_id", "year").distinct()


# Rings in units of a 10-pixel part of the raster, one for each region: the tables' own rows make the polygons.
RINGS_SQL = """rings AS (SELECT r_regionkey AS poly_id, s.seq, 5.37 + 8 * r_regionkey + s.dx AS x, 0.21 + s.dy * (1 + r_regionkey) AS y FROM region,
  (VALUES (0, 0.0, 0.0), (1, 18.0, 1.3), (2, 12.4, 9.2), (3, 9.1, 4.4)) s(seq, dx, dy))"""


def rings(spark: SparkSession, d: str) -> DataFrame:
    """A concave ring for each region; neighbours overlap."""
    corners = ((0, 0.0, 0.0), (1, 18.0, 1.3), (2, 12.4, 9.2), (3, 9.1, 4.4))
    s = F.explode(F.array(*[F.struct(F.lit(q).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for q, x, y in corners]))
    r = X.table(spark, d, "region").select(F.col("r_regionkey").alias("poly_id"), s.alias("s"))
    return r.select("poly_id", "s.seq", (5.37 + 8 * F.col("poly_id") + F.col("s.dx")).alias("x"), (0.21 + F.col("s.dy") * (1 + F.col("poly_id"))).alias("y"))


INSIDE_SQL = f"""{PIXELS}, {RINGS_SQL}, edges AS (
  SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM rings WINDOW w AS (PARTITION BY poly_id ORDER BY seq)
), inside AS (SELECT p.key AS id, e.poly_id FROM pixels p JOIN edges e ON (y1 > row + 0.5) <> (y2 > row + 0.5)
  AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY p.key, e.poly_id HAVING count(*) % 2 = 1)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return X.pixels(spark, d).select(F.col("key").alias("id"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))


@query(f"WITH {INSIDE_SQL} SELECT id, poly_id FROM inside")
def jn5_points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_polygons(points(spark, d), rings(spark, d))


@query(f"WITH {INSIDE_SQL} SELECT p.key AS id, coalesce(max(poly_id), -1) AS poly_id FROM pixels p LEFT JOIN inside ON id = p.key GROUP BY p.key")
def rst4_continent_layer(spark: SparkSession, d: str) -> DataFrame:
    return spatial.last_polygon(points(spark, d), rings(spark, d))


@query(f"""WITH {PIXELS}, {RINGS_SQL}, edges AS (
  SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM rings WINDOW w AS (PARTITION BY poly_id ORDER BY seq)
), corners AS (SELECT key, k, col + 0.5 + sx * 0.5 AS x, row + 0.5 + sy * 0.5 AS y FROM pixels, (VALUES (0, -1, -1), (1, -1, 1), (2, 1, -1), (3, 1, 1)) c(k, sx, sy)
), inside AS (SELECT key, k, poly_id FROM corners c JOIN edges e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY key, k, poly_id HAVING count(*) % 2 = 1
), whole AS (SELECT key AS id, poly_id FROM inside GROUP BY key, poly_id HAVING count(*) = 4
), cut AS (SELECT key, poly_id FROM pixels, edges WHERE
  greatest(0.0, CASE WHEN x2 = x1 THEN CASE WHEN x1 > col AND x1 < col + 1 THEN 0.0 ELSE 2.0 END ELSE least((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)) END,
    CASE WHEN y2 = y1 THEN CASE WHEN y1 > row AND y1 < row + 1 THEN 0.0 ELSE 2.0 END ELSE least((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1)) END)
  < least(1.0, CASE WHEN x2 = x1 THEN CASE WHEN x1 > col AND x1 < col + 1 THEN 1.0 ELSE -1.0 END ELSE greatest((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)) END,
    CASE WHEN y2 = y1 THEN CASE WHEN y1 > row AND y1 < row + 1 THEN 1.0 ELSE -1.0 END ELSE greatest((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1)) END))
SELECT w.id, w.poly_id FROM whole w LEFT JOIN (SELECT DISTINCT * FROM cut) c ON c.key = w.id AND c.poly_id = w.poly_id WHERE c.key IS NULL""")
def jn5_boxes_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return spatial.boxes_in_polygons(points(spark, d), rings(spark, d))


# Cells laid over the raster: a customer's cell of 3.5 x 2.5 pixels.
OVER_SQL = f"""{CELLS}, over AS (SELECT id, x * 0.02 + 0.3 AS minx, y * 0.02 + 0.3 AS miny, x * 0.02 + 3.8 AS maxx, y * 0.02 + 2.8 AS maxy FROM cells)"""


def over(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x") * 0.02, F.col("y") * 0.02
    return X.cells(spark, d).select("id", (x + 0.3).alias("minx"), (y + 0.3).alias("miny"), (x + 3.8).alias("maxx"), (y + 2.8).alias("maxy"))


TOUCH = "col < maxx AND col + 1 > minx AND row < maxy AND row + 1 > miny"


@query(f"WITH {PIXELS}, {OVER_SQL} SELECT id, row, col FROM over JOIN pixels ON {TOUCH}")
def jn6_pixels_in_cells(spark: SparkSession, d: str) -> DataFrame:
    return spatial.pixels_in_cells(X.pixels(spark, d).select("row", "col"), over(spark, d)).select("id", "row", "col")


@query(f"""WITH {PIXELS}, t AS (SELECT row, col FROM pixels WHERE gap), s AS (SELECT row, col, value FROM pixels WHERE NOT gap AND value >= -100)
SELECT row, col, srow, scol, rank FROM (SELECT t.row, t.col, s.row AS srow, s.col AS scol,
  row_number() OVER (PARTITION BY t.row, t.col ORDER BY (t.row - s.row) ** 2 + (t.col - s.col) ** 2, s.row, s.col) AS rank
  FROM t JOIN s ON s.row BETWEEN t.row - 12 AND t.row + 12 AND s.col BETWEEN t.col - 12 AND t.col + 12) WHERE rank <= 5""")
def jn7_nearest_pixels(spark: SparkSession, d: str) -> DataFrame:
    px = X.pixels(spark, d)
    found = spatial.knn(px.where("gap"), px.where("not gap and value >= -100").select("row", "col", "value"))
    return found.select("row", "col", "srow", "scol", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PIXELS}, t AS (SELECT row, col FROM pixels WHERE gap), s AS (SELECT row, col FROM pixels WHERE NOT gap AND value >= -100)
SELECT row, col, count(*) AS n, max(d2)::BIGINT AS farthest FROM (SELECT t.row, t.col, (t.row - s.row) ** 2 + (t.col - s.col) ** 2 AS d2,
  row_number() OVER (PARTITION BY t.row, t.col ORDER BY (t.row - s.row) ** 2 + (t.col - s.col) ** 2, s.row, s.col) AS rank
  FROM t JOIN s ON s.row BETWEEN t.row - 12 AND t.row + 12 AND s.col BETWEEN t.col - 12 AND t.col + 12) WHERE rank <= 3 GROUP BY row, col""")
def srt4_nearest_three(spark: SparkSession, d: str) -> DataFrame:
    """The k nearest for another k: how many were found, and how far the last one is."""
    px = X.pixels(spark, d)
    found = spatial.knn(px.where("gap"), px.where("not gap and value >= -100").select("row", "col", "value"), k=3)
    return found.groupBy("row", "col").agg(F.count("*").alias("n"), F.max("d2").cast("long").alias("farthest"))


@query(f"""WITH {CELLS} SELECT id, round(lon, 6) AS cx, round(lat, 6) AS cy, round(lon - 0.5, 6) AS ux, round(lat + 0.5, 6) AS uy FROM cells""")
def scl9_centroids(spark: SparkSession, d: str) -> DataFrame:
    box = F.col("box")
    (cx, cy), (ux, uy) = C.centroid(box), C.upper_left(box)
    x = X.cells(spark, d).select("id", spatial.cell_bounds("lon", "lat").alias("box"))
    return x.select("id", *[F.round(v, 6).alias(n) for v, n in ((cx, "cx"), (cy, "cy"), (ux, "ux"), (uy, "uy"))])


@query(f"""WITH {CELLS}, k AS (SELECT ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) AS n
), f AS (SELECT n, cos(radians(30)) * tan(pi() / 4 + radians(30) / 2) ** n / n AS f FROM k)
SELECT id, round(6378137.0 * f / tan(pi() / 4 + radians(lat) / 2) ** n * sin(n * radians(lon - 10)) / 1000, 3) AS px,
  round((6378137.0 * f - 6378137.0 * f / tan(pi() / 4 + radians(lat) / 2) ** n * cos(n * radians(lon - 10))) / 1000, 3) AS py
FROM cells, f WHERE lat BETWEEN 20 AND 70 AND lon BETWEEN -30 AND 60""")
def scl10_lambert(spark: SparkSession, d: str) -> DataFrame:
    x, y = C.lambert(F.col("lon"), F.col("lat"), 30, 60, 10)
    near = X.cells(spark, d).where("lat between 20 and 70 and lon between -30 and 60")
    return near.select("id", F.round(x / 1000, 3).alias("px"), F.round(y / 1000, 3).alias("py"))
