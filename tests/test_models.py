"""Boosted trees of many fits at once, the model store, and the window experiment."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geogrid.operators import boosting, model_store
from geogrid.operators.storage import scratch


def plain_boost(v, y, w, cuts, s, squared):
    """One fit, node by node."""
    bins = np.stack([np.searchsorted(c, v[:, j]) for j, c in enumerate(cuts)], axis=1)
    mean = (w * y).sum() / w.sum()
    m = np.full(len(v), mean if squared else np.log(mean / (1 - mean)))
    for _ in range(s.rounds):
        p = m if squared else 1 / (1 + np.exp(-m))
        g, h = w * (y - p), w * (np.ones(len(v)) if squared else p * (1 - p))
        node, step = np.zeros(len(v), int), np.zeros(len(v))
        for level in range(s.depth):
            new = node.copy()
            for k in range(2**level):
                here = node == k
                G, H = g[here].sum(), h[here].sum()
                best = (1e-9, None)
                for j, c in enumerate(cuts):
                    for b in range(s.bins):
                        left = here & (bins[:, j] <= b)
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl < s.least or H - hl < s.least:
                            continue
                        gain = gl**2 / (hl + s.penalty) + (G - gl) ** 2 / (H - hl + s.penalty) - G**2 / (H + s.penalty)
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, b))
                if best[1]:
                    j, b = best[1]
                    new[here] = 2 * k + (bins[here, j] > b)
                else:
                    new[here] = 2 * k
                if level == s.depth - 1:
                    for side in range(2):
                        leaf = here & (new == 2 * k + side)
                        step[leaf] = s.rate * g[leaf].sum() / (h[leaf].sum() + s.penalty)
            node = new
        m = m + step
    return m


def test_fits_at_once_are_those_of_a_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CELLS", 300)
    monkeypatch.setattr(boosting, "FITS", 3)
    r = np.random.default_rng(1)
    n, fits = 240, 7
    rows, tables = [], {}
    for g in (0, 5):
        v = np.round(r.normal(size=(n, 4)), 3)
        w = r.integers(0, 3, (n, fits))
        y = np.stack([(v[:, 0] + v[:, k % 4] * (k + 1) > 0.3).astype(float) for k in range(fits - 1)] + [v[:, 1] ** 2 + g], axis=1)
        tables[g] = v, w, y
        rows += [(g, int(i), v[i].tolist(), y[i].tolist(), w[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>, y array<double>, w array<tinyint>").repartition(5)
    s = boosting.Settings(rounds=3, depth=2, bins=8)
    allowed = np.ones((fits, 4), bool)
    allowed[2, :2] = False
    squared = np.arange(fits) == fits - 1
    cuts = boosting.edges(df, s.bins)
    found = boosting.fit(df, boosting.Fits(fits, allowed, squared=squared, settings=s))
    got = {(x["g"], x["id"], x["fit"]): x["score"] for x in boosting.score(df, found).collect()}
    assert len(got) == 2 * n * fits
    for g, (v, w, y) in tables.items():
        for k in range(fits):
            only = [c if allowed[k, j] else np.zeros(0) for j, c in enumerate(cuts)]
            m = plain_boost(v, y[:, k], w[:, k].astype(float), only, s, squared[k])
            want = m if squared[k] else 1 / (1 + np.exp(-m))
            assert np.allclose([got[g, i, k] for i in range(n)], want, atol=1e-9), (g, k)


def test_bits_are_weights_and_positives_weigh_more(spark):
    r = np.random.default_rng(2)
    v, y = np.round(r.normal(size=(300, 2)), 2), r.integers(0, 2, 300).astype(float)
    bits = r.integers(0, 2, (300, 70))
    longs = np.packbits(np.pad(bits, ((0, 0), (0, 58))), axis=1, bitorder="little").view(np.int64)
    s = boosting.Settings(rounds=2, depth=2, bins=8)
    make = lambda w, kind: spark.createDataFrame([(0, i, v[i].tolist(), [float(y[i])], [int(x) for x in w[i]]) for i in range(300)], f"g int, id long, v array<double>, y array<double>, w array<{kind}>")
    lanes = [69, 0, 69]
    a = boosting.fit(make(longs, "long"), boosting.Fits(3, np.ones((3, 2), bool), lanes, True, positive=[1, 1, 3.0], settings=s))[0]
    b = boosting.fit(make(np.where(y[:, None] == 1, bits[:, [69, 0, 69]] * np.array([1, 1, 3]), bits[:, [69, 0, 69]]), "tinyint"), boosting.Fits(3, np.ones((3, 2), bool), settings=s))[0]
    assert np.allclose(a.margins(v), b.margins(v)) and (a.weights == b.weights).all()


def sample(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(float, v), int(v[0] - v[2] > 0.8)) for i, v in enumerate(r.normal(size=(400, 3)).round(3))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def test_a_killed_run_resumes_with_the_models_that_lack(spark, monkeypatch):
    df, s = sample(spark), boosting.Settings(rounds=2, depth=2, bins=8)
    whole = model_store.ModelStore(spark, scratch(spark, "store"))
    assert whole.train(df, ["a", "b", "c"], 5, ratio=0.5, at_once=2, settings=s) == [0, 1, 2, 3, 4]
    killed = model_store.ModelStore(spark, scratch(spark, "store"))
    fit, calls = boosting.fit, []

    def once(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return fit(*args)

    monkeypatch.setattr(boosting, "fit", once)
    with pytest.raises(KeyboardInterrupt):
        killed.train(df, ["a", "b", "c"], 5, ratio=0.5, at_once=2, settings=s)
    assert killed.unfinished(5) == [2, 3, 4]
    assert killed.train(df, ["a", "b", "c"], 5, ratio=0.5, at_once=2, settings=s) == [2, 3, 4] and len(calls) == 4
    assert killed.train(df, ["a", "b", "c"], 5, ratio=0.5, at_once=2, settings=s) == []
    key = lambda st: sorted((r["id"], r["model_id"], round(r["prob"], 12)) for r in st.predict(df)[0].collect())
    assert key(whole) == key(killed) and len(key(whole)) == 2000


def test_models_restore_order_and_scaler_and_failing_ones_are_told(spark):
    df, s = sample(spark), boosting.Settings(rounds=2, depth=2, bins=8)
    store = model_store.ModelStore(spark, scratch(spark, "store"))
    assert store.rows().count() == 0 and store.predict(df)[0].count() == 0
    store.train(df, ["c", "a", "b"], 3, ratio=0.5, settings=s)
    store.train(df.where("label = 0"), ["c", "a", "b"], 4, ratio=0.5, settings=s)  # the fourth has one class
    broken = store.rows().where("model_id = 1").withColumn("run", F.lit(99).cast("long")).withColumn("value", F.slice("value", 1, 2))
    broken.coalesce(1).write.mode("append").parquet(store.path)
    shuffled = df.select("b", F.lit("x").alias("extra"), "label", "c", "id", "a")
    p, problems = store.predict(shuffled)
    assert {r["model_id"]: r["reason"].split(" ")[0] for r in problems.collect()} == {1: "its", 3: "its"}
    rows = {r["model_id"]: r for r in store.rows().collect()}
    got = {(r["model_id"], r["id"]): r["prob"] for r in p.collect()}
    assert {m for m, _ in got} == {0, 2} and len(got) == 800
    for r in df.collect():  # each model by hand
        for m in (0, 2):
            row = rows[m]
            x = [(r[c] - mean) / std for c, mean, std in zip(row["features"], row["means"], row["stds"], strict=True)]
            margin = row["base"]
            for t in range(2):
                k = 0
                for _ in range(2):
                    k = 2 * k + 1 + (x[row["feature"][3 * t + k]] > row["threshold"][3 * t + k])
                margin += row["value"][4 * t + k - 3]
            assert abs(got[m, r["id"]] - 1 / (1 + np.exp(-margin))) < 1e-12
    assert p._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    parts, _ = store.forests(df, bound=100)
    assert sorted(m for g, _, _ in parts for m in g) == [0, 2] and len(parts) == 2
    assert store.predict(df, bound=100)[0].count() == 800
    assert {r["model_id"] for r in store.predict(df.drop("b"))[1].collect()} == {0, 1, 2, 3}
