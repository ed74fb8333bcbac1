"""The derived tables of ``sources.fixtures`` in DuckDB's SQL, as common table expressions."""

from __future__ import annotations


def u(salt: str, key: str) -> str:
    """``functions.rng.uniform``; ``salt`` is text or, if it begins with =, an expression."""
    s = salt[1:] if salt.startswith("=") else f"'{salt}'"
    return f"((('0x' || substr(md5(concat({s}, cast({key} AS VARCHAR))), 1, 8))::BIGINT)::DOUBLE / 4294967296)"


CELLS = f"""cells AS (SELECT c_custkey AS id, 2000 * {u("gx", "c_custkey")} AS x, 2000 * {u("gy", "c_custkey")} AS y,
  360 * {u("lo", "c_custkey")} - 180 AS lon, 180 * {u("la", "c_custkey")} - 90 AS lat, (c_nationkey % 2)::INT AS country,
  ({u("ic", "c_custkey")} < 0.2)::INT AS is_city,
  CASE WHEN {u("ic", "c_custkey")} < 0.2 THEN floor(-400 + 2300 * {u("bb", "c_custkey")})::INT END AS birth,
  CASE WHEN {u("ic", "c_custkey")} < 0.2 THEN c_custkey % 37 ELSE -1 END::BIGINT AS city_id, c_acctbal AS elevation FROM customer)"""
CITIES = f"""cities AS (SELECT *, birth + floor(200 + 600 * {u("e", "city_id")})::INT AS end_yr FROM (
  SELECT s_suppkey AS city_id, 2000 * {u("cx", "s_suppkey")} AS x, 2000 * {u("cy", "s_suppkey")} AS y,
  floor(-400 + 23 * floor(100 * {u("b", "s_suppkey")}))::INT AS birth FROM supplier))"""
PIXELS = f"""pixels AS (SELECT p_partkey AS key, (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col,
  CASE WHEN {u("nd", "p_partkey")} < 0.05 THEN -9999.0 ELSE p_retailprice END::DOUBLE AS value, {u("gap", "p_partkey")} < 0.1 AS gap,
  p_retailprice AS price FROM part)"""
CROPS = PIXELS + f""", crop_yields AS (SELECT key, row, col, crop, floor(price * {u("=crop", "key")} - 150)::DOUBLE AS "yield"
  FROM pixels, (VALUES ('c1'), ('c2'), ('c3')) c(crop))"""
CLIMATE = PIXELS + f""", climate AS (SELECT scenario, model, row, col, floor(1000 * {u("=scenario || model", "key")})::DOUBLE AS raw
  FROM pixels, (VALUES ('s1'), ('s2')) s(scenario), (VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m4')) m(model)
  WHERE NOT (scenario = 's2' AND model = 'm4'))"""
PREDS = f"""preds AS (SELECT scenario, model_id::INT AS model_id, c_custkey AS id, {u("=scenario || model_id", "c_custkey")} AS prob
  FROM customer, (VALUES ('current'), ('future')) s(scenario), range(10) m(model_id))"""
LINES = """lines AS (SELECT (l_returnflag = 'R' AND l_quantity > 20)::INT AS label, l_discount AS score, l_tax AS tax, l_returnflag AS flag FROM lineitem)"""
SERIES = "series AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS value FROM events GROUP BY 1)"
TILES = "tiles AS (SELECT vec_id AS id, embedding AS px, label FROM embeddings)"
