"""Years and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import reports, timeline
from ..sources import fixtures as X
from .registry import query
from .sql import CELLS, CITIES, SERIES, u

WINDOWS = """w AS (SELECT start::INT AS start, (start + 300)::INT AS "end" FROM
  (SELECT unnest(range(a, b - 300 + 1, 50)) AS start FROM (SELECT min(birth)::BIGINT AS a, max(birth)::BIGINT AS b FROM cells)))"""


@query(f'WITH {CELLS}, {WINDOWS} SELECT start, "end", start + 150.0 AS mid FROM w')
def win4_hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    return timeline.hopping_windows(X.cells(spark, d), "birth")


@query(f'WITH {CELLS}, {WINDOWS} SELECT id, start FROM cells JOIN w ON birth >= start AND birth < "end"')
def jn12_window_members(spark: SparkSession, d: str) -> DataFrame:
    c = X.cells(spark, d)
    return timeline.assign_windows(c, timeline.hopping_windows(c, "birth"), "birth").select("id", "start")


@query(f'WITH {CELLS}, {WINDOWS} SELECT start, "end", count(*) AS n FROM cells JOIN w ON birth >= start AND birth < "end" GROUP BY ALL HAVING count(*) >= 10')
def flt5_full_windows(spark: SparkSession, d: str) -> DataFrame:
    c = X.cells(spark, d)
    return timeline.windows_with_min(c, timeline.hopping_windows(c, "birth"), "birth", 10)


@query(f"""WITH {CELLS} SELECT id, CASE WHEN birth > 800 AND is_city = 1 THEN 0 ELSE is_city END AS is_city, birth FROM cells
WHERE NOT coalesce(birth < 500 AND is_city = 1, false)""")
def flt2_eligible(spark: SparkSession, d: str) -> DataFrame:
    return timeline.eligible(X.cells(spark, d), 500, 800).select("id", "is_city", "birth")


@query(f"WITH {CITIES} SELECT city_id, birth FROM cities WHERE birth BETWEEN -250 AND 1850")
def flt3_year_range(spark: SparkSession, d: str) -> DataFrame:
    return timeline.between_years(X.cities(spark, d), "birth", -250, 1850).select("city_id", "birth")


@query(f"""WITH {CELLS}, {CITIES}, y AS (SELECT DISTINCT birth AS v FROM cities)
SELECT id, birth, coalesce((SELECT min(v) FROM y WHERE v >= cells.birth), -1000)::BIGINT AS matched FROM cells WHERE birth IS NOT NULL""")
def jn3_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return timeline.asof_forward(X.cells(spark, d).where("birth is not null").select("id", "birth"), X.cities(spark, d), "birth", "birth", -1000)


PERIODS = [("early", -400, 0), ("classical", 0, 500), ("middle", 500, 1400), ("modern", 1400, 1901)]


@query(f"""WITH {CELLS} SELECT id, CASE WHEN birth >= -400 AND birth < 0 THEN 'early' WHEN birth >= 0 AND birth < 500 THEN 'classical'
  WHEN birth >= 500 AND birth < 1400 THEN 'middle' WHEN birth >= 1400 AND birth < 1901 THEN 'modern' END AS period,
  CASE WHEN ceil(birth / 100.0) > -4 AND ceil(birth / 100.0) <= 5 THEN 'old' WHEN ceil(birth / 100.0) > 5 AND ceil(birth / 100.0) <= 19 THEN 'new' END AS era FROM cells""")
def jn11_interval_labels(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.label_interval(X.cells(spark, d), "birth", PERIODS).withColumn("c", C.century("birth"))
    return timeline.label_interval(x, "c", [("old", -4, 5), ("new", 5, 19)], "right", "era").select("id", "period", "era")


@query(f"WITH {CELLS} SELECT id, ceil(birth / 100.0::DOUBLE)::INT AS century FROM cells WHERE birth IS NOT NULL")
def scl4_century(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(spark, d).where("birth is not null").select("id", C.century("birth").alias("century"))


@query(f"""WITH {CELLS}, {WINDOWS} SELECT start, trunc((start + "end") / 2.0::DOUBLE)::INT
  - ((trunc((start + "end") / 2.0::DOUBLE)::INT % 100) + 100) % 100 AS mid FROM w""")
def scl5_snapped_mid(spark: SparkSession, d: str) -> DataFrame:
    return timeline.hopping_windows(X.cells(spark, d), "birth").select("start", C.snap_mid("start", "end").alias("mid"))


@query("""SELECT p_partkey AS key, (1950 + 1000 * (-(p_partkey % 40) / 10.0::DOUBLE))::INT AS year,
  CASE WHEN (1950 + 1000 * (-(p_partkey % 40) / 10.0::DOUBLE))::INT < 0 THEN 'BCE' ELSE 'CE' END AS era FROM part""")
def scl6_calendar(spark: SparkSession, d: str) -> DataFrame:
    x = X.table(spark, d, "part").select(F.col("p_partkey").alias("key"), C.calendar(-(F.col("p_partkey") % 40) / 10.0).alias("year"))
    return x.withColumn("era", C.era("year"))


@query(f"""WITH {CITIES} SELECT city_id, CASE WHEN birth <= 1500 THEN birth ELSE end_yr END AS agri FROM cities""")
def prj7_period_column(spark: SparkSession, d: str) -> DataFrame:
    """Two years' choices of a column, each for its part of the towns."""
    t = X.cities(spark, d)
    part = lambda rows, year: rows.select("city_id", C.period_column(year, "birth", "end_yr").alias("agri"))
    return part(t.where("birth <= 1500"), 1500).unionByName(part(t.where("birth > 1500"), 1600))


@query(f"""WITH {CELLS} SELECT country, count(birth) AS n, round(avg(birth), 6) AS mean, round(stddev_samp(birth) / sqrt(count(birth)), 6) AS se,
  round(avg(birth) - 1.96 * (stddev_samp(birth) / sqrt(count(birth))), 6) AS low, round(avg(birth) + 1.96 * (stddev_samp(birth) / sqrt(count(birth))), 6) AS high FROM cells GROUP BY country""")
def agg12_mean_and_error(spark: SparkSession, d: str) -> DataFrame:
    x = reports.mean_se(X.cells(spark, d), ["country"], "birth")
    return x.select("country", "n", *[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")])


@query(f"WITH {CELLS} SELECT birth, count(*) AS n, sum(is_city)::BIGINT AS towns FROM cells WHERE birth IS NOT NULL GROUP BY birth")
def agg22_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(spark, d).where("birth is not null").groupBy("birth").agg(F.count("*").alias("n"), F.sum("is_city").alias("towns")).orderBy("birth")


_W = [math.exp(-(k * k) / 50) for k in range(-20, 21)]
KERNEL = ", ".join(f"({k}, {w / sum(_W)!r}::DOUBLE)" for k, w in zip(range(-20, 21), _W, strict=True))


@query(f"""WITH {SERIES}, s AS (SELECT value, row_number() OVER (ORDER BY hour) - 1 AS pos FROM series), n AS (SELECT count(*) AS n FROM s)
SELECT a.pos, round(sum(k.w * b.value), 6) AS smoothed FROM s a, n, (VALUES {KERNEL}) k(k, w)
JOIN s b ON b.pos = least((((a.pos + k.k) % (2 * n)) + 2 * n) % (2 * n), 2 * n - 1 - ((((a.pos + k.k) % (2 * n)) + 2 * n) % (2 * n))) GROUP BY a.pos""")
def win5_smoothed_series(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.smooth(X.series(spark, d), "hour", "value")
    return x.select("pos", F.round("smoothed", 6).alias("smoothed"))


@query("""SELECT (o_orderkey % 24)::INT AS t, round(avg(o_totalprice) - 273.15, 4) AS value FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1""")
def agg8_regional_series(spark: SparkSession, d: str) -> DataFrame:
    o = X.table(spark, d, "orders").select((F.col("o_orderkey") % 24).cast("int").alias("t"), F.col("o_custkey").alias("cell"), F.col("o_totalprice").alias("value"))
    members = X.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("cell"))
    return timeline.regional_series(o, members, -273.15).select("t", F.round("value", 4).alias("value"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'")
def src7_cube_slice(spark: SparkSession, d: str) -> DataFrame:
    """A time slice of a table; the range reaches the scan."""
    o = X.table(spark, d, "orders").where("o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
    return o.select("o_orderkey", "o_totalprice")


@query(f"WITH {CELLS} SELECT id, row_number() OVER (ORDER BY birth, {u('srt', 'id')}, id) - 1 AS nth FROM cells WHERE birth IS NOT NULL")
def srt1_random_within_birth(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.rng import uniform

    x = X.cells(spark, d).where("birth is not null").withColumn("r", uniform("srt", "id"))
    x = timeline.numbered(x.select("id", F.struct("birth", "r", "id").alias("o")), "o", "nth")
    return x.select("id", F.col("nth").cast("long").alias("nth"))
