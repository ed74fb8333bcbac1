"""Findings of round 4: signs of zeros, jobs of many fits, all pairs of vectors, and gaps far from any source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geogrid.functions import columns as C
from geogrid.plans.catalogue import QUERIES, SQL


def test_rounding_is_that_of_sql(spark, duck):
    r = np.random.default_rng(1)
    x = [-1e-6, 1e-6, 0.0, -0.0, 81.352685, -81.352685, 0.015625, 1e9 + 0.1, None, *((r.integers(-(10**7), 10**7, 500) * 10 + 5) / 1e6).tolist(), *r.normal(size=500).tolist()]
    got = [v["y"] for v in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double").select("id", C.half_away("x", 5).alias("y")).orderBy("id").collect()]
    want = [v for (v,) in duck.execute("SELECT round(x, 5) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x]).fetchall()]
    assert list(map(str, got)) == list(map(str, want))  # as text, so that the sign of a zero counts


def test_synthetic_rows_keep_the_sign_of_a_zero(spark, tmp_path):
    import duckdb

    duckdb.sql(f"COPY (SELECT i::BIGINT AS vec_id, [(-1e-6)::FLOAT, (i % 7)::FLOAT, (i / 7)::FLOAT] AS embedding, (CASE WHEN i < 20 THEN 3 ELSE 1 END)::INT AS label FROM range(83) t(i)) TO '{tmp_path}/embeddings.parquet'")
    got = {(r["id"], r["nth"]): str(r["px"]) for r in QUERIES["smp2_smote"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {(i, n): str(px) for i, n, px in c.sql(SQL["smp2_smote"]).fetchall()}
    assert "-0.0" in str(want.values()) and got == want


def test_numbers_in_batches_are_those_of_hashes():
    import hashlib

    import pyarrow as pa

    from geogrid.functions.rng import uniforms

    heads = [f"row{s}_" for s in (-400, 0, 1250)] * 4 + ["x" * 60, "", "ü"]
    tails = [str(i) for i in (1, 22, 333, 44444)] * 3 + ["y" * 70, "", "é"]
    middles = ["0_", "17_", ""]
    got = {(int(i), m): float(x) for rows, m, u in uniforms(pa.array(heads), middles, pa.array(tails)) for i, x in zip(rows, u, strict=True)}
    assert got == {(i, m): int(hashlib.md5((h + mid + t).encode()).hexdigest()[:8], 16) / 2**32 for i, (h, t) in enumerate(zip(heads, tails, strict=True)) for m, mid in enumerate(middles)}


def test_membership_of_one_file_is_drawn_in_many_tasks(spark, tmp_path):
    from geogrid.operators import experiments

    rows = spark.range(0, 4000, 1, 1).selectExpr("(id % 3 * 50)::int as start", "id", "(case when id % 10 = 0 then id % 7 else -1 end) as city_id", "(id % 10 = 0)::int as label")
    spark.conf.set("spark.geogrid.job", f"file://{tmp_path}")
    try:
        x = experiments.membership(rows, 70, ratio=0.5)
    finally:
        spark.conf.unset("spark.geogrid.job")
    assert len(list(tmp_path.glob("parts-*/part-*.parquet"))) > 1
    r = F.explode(F.sequence(F.lit(0), F.lit(69))).alias("r")
    found = x.select("*", r).select("start", "label", "r", experiments.bit("train", F.col("r")).alias("train"), experiments.bit("tested", F.col("r")).alias("tested"))
    assert found.where("train and tested").count() == 0 and found.where("label = 1 and not train and not tested").count() == 0
    n = found.where("label = 0").agg(F.avg(F.col("train").cast("int") + F.col("tested").cast("int"))).first()[0]
    assert abs(n - 2 * 400 / 3600) < 0.01


def test_only_asked_pairs_are_scored_and_learnt_from(spark):
    from geogrid.operators import boosting

    r = np.random.default_rng(5)
    n, lanes = 300, np.array([0, 65, 65, 3])
    v, y, g = r.normal(size=(n, 3)).round(3), r.integers(0, 2, n).astype(float), r.integers(0, 2, n) * 7
    bits = r.random((n, 128)) < 0.1
    bits[:, 3] = False  # no row has a weight in the last fit
    longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    df = spark.createDataFrame([(int(g[i]), i, v[i].tolist(), [float(y[i])], longs[i].tolist()) for i in range(n)], "g int, id long, v array<double>, y array<double>, w array<long>").repartition(3)
    fits = boosting.Fits(4, np.ones((4, 3), bool), lanes, True, settings=boosting.Settings(rounds=2, depth=2, bins=8))
    batch = df.toArrow().combine_chunks().to_batches()[0]
    pairs = sum(len(row) for _, _, row, *_ in fits.read(batch))
    assert pairs == bits[:, lanes].sum() < n  # and so no work is done for the others
    found = boosting.fit(df, fits)
    dense = {(x["id"], x["fit"]): x["score"] for x in boosting.score(df, found).collect()}
    got = {(x["id"], x["fit"]): x["score"] for x in boosting.score_asked(df, found, "w", lanes).collect()}
    assert got.keys() == {(i, k) for i in range(n) for k, lane in enumerate(lanes) if bits[i, lane]}
    assert all(abs(dense[k] - x) < 1e-12 for k, x in got.items())
    assert {k for k, f in found.items() if np.allclose(f.base[3], 0) and (f.value[3] == 0).all()} == {0, 7}


def test_silhouette_by_blocks_is_that_of_all_pairs(spark, monkeypatch):
    from geogrid.operators import metrics

    monkeypatch.setattr(metrics, "CELLS", 64)  # some rows at a time
    r = np.random.default_rng(6)
    v = np.concatenate([r.normal(c, 1, (60, 3)) for c in (0, 2, 5)] + [np.full((20, 3), 4.0), 100 + r.normal(0, 1e-6, (40, 3))])  # copies, and vectors much closer than long
    label = np.concatenate([np.repeat([4, 1, 9], 60), r.integers(0, 2, 20), np.repeat([20, 21], 20)])
    label[5] = 77  # alone
    rows = [(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))]
    df = spark.createDataFrame([*rows, (1000, [0.0, 0.0, 0.0], None), (1001, None, 4)], "id long, px array<double>, label int").repartition(5)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = 0.0
    for i in range(len(v)):
        own = (label == label[i]) & (np.arange(len(v)) != i)
        if own.any():
            a, b = d[i, own].mean(), min(d[i, label == y].mean() for y in set(label) - {label[i]})
            want += (b - a) / max(a, b) if max(a, b) else 0
    for block in (None, 16, 1000):
        got = metrics.silhouette(df, block=block).first()
        assert got["n"] == len(v) + 2 and abs(got["silhouette"] - want / (len(v) + 2)) < 1e-6
    few = metrics.silhouette(df.where("id < 0")).first()
    assert (few["n"], few["silhouette"]) == (0, None)


def test_gap_filling_sends_no_pixels_to_the_driver(spark):
    from geogrid.operators import raster, spatial

    px = spark.range(1200).selectExpr("if(id % 2 = 0, 'a', 'b') as name", "(id div 20)::int as row", "(id % 20)::int as col", "(id % 9)::double as value", "(id % 7 = 0 or id between 300 and 520) as gap")
    plan = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    filled = raster.idw_fill(px, k=3, raster="name")
    found = spatial.knn(px.where("gap"), px.where("not gap"), 3, reach=2, by=("name",))
    assert filled.count() == found.select("name", "row", "col").distinct().count() == px.where("gap").count()
    for df in (filled, found):
        assert "Join" in plan(df) and "Broadcast" not in plan(df)


def test_a_step_adds_up_the_same_rows_as_the_last_scan(spark):
    from geogrid.operators import clustering

    r = np.random.default_rng(7)
    v = r.normal(size=(500, 6)).round(2)
    for k in (1, 2, 9, 300):
        c = r.normal(size=(4, k, 6)).round(2)
        c[0, -1] = c[0, 0]  # the first of equally near centres has the rows
        c[1, : min(k, 5)] = v[: min(k, 5)]
        full, step = np.zeros((4, k, 9)), np.zeros((4, k, 7))
        clustering._add(full, c, v)
        clustering._add_sums(step, clustering._turned(c), v[:300])
        clustering._add_sums(step, clustering._turned(c), v[300:])
        assert np.allclose(step, full[:, :, :7], atol=1e-9) and (step[:, :, 6].sum(1) == 500).all()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, px array<double>")
    fits = clustering.Fits(df, "px", [(3, 0), (3, 1)])
    assert {k: x.shape for k, x in fits._scan(fits.centres, told=False).items()} == {3: (2, 3, 7)}
    assert fits.rows.rdd.getNumPartitions() <= 2
