"""Edge cases worked out by hand, and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geogrid.functions import columns as C
from geogrid.operators import clustering, features, metrics, raster, reports, sampling, spatial, tiles, timeline
from geogrid.sources import tables


def test_eligible_keeps_missing_years_and_edges(spark):
    df = spark.createDataFrame([(1, 100, 1), (2, 200, 1), (3, 300, 1), (4, 301, 1), (5, None, 1), (6, 50, 0)], "id int, birth int, is_city int")
    got = {r["id"]: r["is_city"] for r in timeline.eligible(df, 200, 300).collect()}
    assert got == {2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
    with pytest.raises(ValueError):
        timeline.eligible(df.drop("birth"), 0, 1)


def test_hopping_windows_are_half_open_and_may_be_none(spark):
    df = spark.createDataFrame([(0,), (300,), (400,)], "y int")
    w = timeline.hopping_windows(df, "y")
    assert [r["start"] for r in w.orderBy("start").collect()] == [0, 50, 100]
    assert timeline.assign_windows(df, w.where("start = 0"), "y").count() == 1
    assert timeline.hopping_windows(df.where("y < 300"), "y").count() == 0


def test_asof_forward_across_blocks(spark):
    left = spark.createDataFrame([(-5000,), (-1,), (0,), (5,), (9999,), (None,)], "t int")
    right = spark.createDataFrame([(0,), (5000,), (None,)], "v int")
    got = {r["t"]: r["matched"] for r in timeline.asof_forward(left, right, "t", "v", -1000).collect()}
    assert got == {-5000: 0, -1: 0, 0: 0, 5: 5000, 9999: -1000, None: -1000}


def test_smoothing_is_like_a_mirrored_convolution(spark):
    x = [float(random.Random(3).random()) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, v double")
    got = [r["smoothed"] for r in timeline.smooth(df, "i", "v").orderBy("pos").collect()]
    want = np.convolve(np.pad(x, 20, "symmetric"), timeline.kernel(5.0), "valid")
    assert np.allclose(got, want)


def test_snapped_middle_goes_down_for_bce(spark):
    df = spark.createDataFrame([(-350, -50), (0, 300), (-101, 0)], "s int, e int")
    assert [r[0] for r in df.select(C.snap_mid("s", "e")).collect()] == [-200, 100, -100]


def test_within_distance_is_brute_force(spark):
    r = random.Random(5)
    a = [(i, r.uniform(0, 30), r.uniform(0, 30)) for i in range(120)] + [(120, 0.0, 0.0)]
    b = [(i, r.uniform(0, 30), r.uniform(0, 30)) for i in range(80)] + [(80, 3.0, 4.0)]
    want = {(i, j) for i, x, y in a for j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 25}
    for most in (4096, 3):
        got = spatial.within_distance(spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "bid int, bx double, by double"), 5, most).select("id", "bid").collect()
        assert len(got) == len(want)
        assert {tuple(x) for x in got} == want


def test_boxes_cut_by_an_edge_without_a_corner_outside(spark):
    # A notch enters the box from below between its corners.
    ring = [(0, 0.0, 0.0), (1, 4.9, 0.0), (2, 5.0, 5.2), (3, 5.1, 0.0), (4, 10.0, 0.0), (5, 10.0, 10.0), (6, 0.0, 10.0)]
    rings = spark.createDataFrame([(1, *p) for p in ring], "poly_id int, seq int, x double, y double")
    boxes = spark.createDataFrame([(1, 5.0, 5.4), (2, 2.0, 5.0), (3, 9.8, 5.0)], "id int, x double, y double")
    assert [r["id"] for r in spatial.boxes_in_polygons(boxes, rings).collect()] == [2]


def test_nearest_pixels_when_few_are_there(spark):
    t = spark.createDataFrame([(0, 0), (90, 90)], "row int, col int")
    s = spark.createDataFrame([(0, 1, 1.0), (50, 50, 2.0), (91, 91, 3.0)], "row int, col int, value double")
    got = spatial.knn(t, s, 2).orderBy("row", "rank").collect()
    assert [(r["row"], r["value"]) for r in got] == [(0, 1.0), (0, 2.0), (90, 3.0), (90, 2.0)]


def test_idw_takes_a_source_at_the_spot(spark):
    px = spark.createDataFrame([(0, 0, 5.0, True), (0, 1, 2.0, False), (1, 0, 4.0, False), (5, 5, -9999.0, False)], "row int, col int, value double, gap boolean")
    r = raster.idw_fill(px, k=2).first()
    assert (r["n"], r["filled"]) == (2, 3.0)


def test_best_crop_ties_sea_and_bare_land(spark):
    y = spark.createDataFrame([(0, 0, "a", 2.0), (0, 0, "b", 2.0), (0, 1, "a", 0.0), (0, 2, "a", 9.0)], "row int, col int, crop string, yield double")
    ranks = spark.createDataFrame([("a", 1), ("b", 2)], "crop string, rank int")
    land = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "row int, col int, continent int")
    got = {r["col"]: (r["crop_rank"], r["best"]) for r in raster.best_crop(y, ranks, land).collect()}
    assert got == {0: (1, 2.0), 1: (0, -2.0), 2: (-100, -1.0)}


def test_tile_nodata_at_exactly_minus_100(spark):
    px = spark.createDataFrame([(1, -100.0), (1, -101.0), (1, 4.0), (2, -200.0)], "id int, value double")
    got = sorted(r["value"] for r in raster.tile_nodata(px, F.lit(True)).collect())
    assert got == [-100.0, 4.0, 4.0]


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(1.0, 5.0), (1.5, 7.0), (2.0, 9.0)], "x double, v double")
    assert {r["bin"]: r["n"] for r in reports.bin_stats(df, "x", "v").collect()} == {0: 1, 1: 2}
    assert reports.bin_stats(df.where("x = 1"), "x", "v").first()["std"] is None


def test_curves_with_one_score_and_without_positives(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)], "label int, score double")
    r = metrics.areas(metrics.curve(tied, "label", "score")).first()
    assert (r["average_precision"], r["roc_auc"], r["pr_auc"]) == (0.5, 0.5, 0.75)
    r = metrics.areas(metrics.curve(tied.where("label = 0"), "label", "score")).first()
    assert r["roc_auc"] is None and r["average_precision"] is None


def test_curve_ranges_do_not_change_the_result(spark):
    r = random.Random(1)
    rows = [(int(r.random() < 0.3), round(r.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, score double")
    small = df.withColumn("score", F.col("score") / 100_000)  # all of them below 1 / 4096
    old, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found += [metrics.areas(metrics.curve(x, "label", "score")).first() for x in (df, small)]
            widest = metrics.curve(small, "label", "score").groupBy(F.spark_partition_id()).count()
            assert n == "1" or widest.count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(math.isclose(a[c], found[0][c]) for a in found for c in a.asDict())
    scores = sorted({s for _, s in rows}, reverse=True)
    pos, tp, area = sum(y for y, _ in rows), 0, 0.0
    for s in scores:
        here, own = sum(x >= s for _, x in rows), sum(y for y, x in rows if x == s)
        tp += own
        area += own / pos * tp / here
    assert math.isclose(found[0]["average_precision"], area)


def test_confusion_of_nothing_predicted(spark):
    c = metrics.rates(metrics.confusion(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p")).first()
    assert c["mcc"] == 0 and c["precision"] is None and c["recall"] == 0


def test_group_split_leaks_no_group(spark):
    df = spark.createDataFrame([(i, i % 12 if i % 3 else -1, i % 2) for i in range(300)], "id int, city_id int, is_city int")
    x = sampling.group_split(df).where("city_id > -1").groupBy("city_id").agg(F.countDistinct("part").alias("n"))
    assert x.where("n > 1").count() == 0


def test_under_sample_ratio(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id int, label int")
    assert {r["label"]: r["count"] for r in sampling.under_sample(df, ratio=0.5).groupBy("label").count().collect()} == {1: 100, 0: 200}


def test_bootstrap_keeps_class_sizes(spark):
    df = spark.createDataFrame([(0, i) for i in range(30)] + [(1, i) for i in range(7)], "label int, ix long")
    w = sampling.bootstrap_weights(df, 5, by="label").groupBy("rep", "label").agg(F.sum("weight").alias("n"))
    assert {(r["label"], r["n"]) for r in w.collect()} == {(0, 30), (1, 7)}


def test_scaler_of_a_constant_dimension(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "px array<double>")
    got = [r["px"] for r in features.apply_scaler(df, features.fit_scaler(df, "px"), "px").collect()]
    assert got == [[-1.0, 0.0], [1.0, 0.0]]


def test_tile_statistics_of_one_pixel(spark):
    r = tiles.stats(spark.createDataFrame([([2.0],)], "px array<double>")).first()
    assert r["mean"] == 2.0 and r["std"] is None


def test_tile_names_with_negative_years(spark):
    df = spark.createDataFrame([("/a/Y-500_12.tiff",), ("/a/Y1500_3.tiff",), ("/a/Y15.tif",)], "path string")
    assert [tuple(r) for r in df.select(*tables.parse_tile_name("path")).collect()] == [(-500, 12), (1500, 3), (None, None)]


def test_standard_names_keep_a_clashing_column(spark):
    df = spark.createDataFrame([(1, 2)], "cid int, other int").withColumnRenamed("other", "id")
    assert features.standard_names(df, {"cid": "id"}).columns == ["id"]


def test_bilinear_weights_sum_to_one():
    for s, t in ((8, 5), (5, 8), (3, 3)):
        w = raster.bilinear_weights(s, t)
        assert all(math.isclose(sum(x for d, _, x in w if d == k), 1) for k in range(t))


def test_neighbour_counts_are_brute_force(spark):
    r = random.Random(9)
    cells = [(i, r.uniform(0, 300), r.uniform(0, 300)) for i in range(40)]
    towns = [(i, r.uniform(0, 300), r.uniform(0, 300), r.choice([-5, 0, 7, 8, 20]), r.choice([1, 7, 8, 9, 30, None])) for i in range(60)]
    towns += [(60, 1.0, 1.0, None, 9)]
    want = {}
    for i, x, y in cells:
        for year in {t[3] for t in towns if t[3] is not None}:
            d = [math.hypot(x - u, y - v) for _, u, v, a, b in towns if a is not None and b is not None and a < year < b]
            n = tuple(sum(z <= k for z in d) for k in (20, 50, 100))
            if n[2]:
                want[i, year] = n
    got = spatial.neighbour_counts(spark.createDataFrame(cells, "id int, x double, y double"), spark.createDataFrame(towns, "city_id int, x double, y double, birth int, end_yr int"))
    assert {(x["id"], x["year"]): (x["n_20"], x["n_50"], x["n_100"]) for x in got.collect()} == want


def test_points_far_left_and_right_of_a_ring(spark):
    ring = [(0, 25.0, 1.0), (1, 61.0, 1.0), (2, 44.0, 33.0), (3, 43.0, 12.0)]
    rings = spark.createDataFrame([(1, *p) for p in ring], "poly_id int, seq int, x double, y double")
    r = random.Random(4)
    points = [(i, r.uniform(-30, 90), r.uniform(-10, 50)) for i in range(600)]
    want = set()
    for i, x, y in points:
        ends = zip(ring, ring[1:] + ring[:1], strict=True)
        if sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (_, a, b), (_, c, d) in ends) % 2:
            want.add(i)
    got = spatial.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), rings)
    assert want and {x["id"] for x in got.collect()} == want


def test_bin_quantiles_are_interpolated(spark):
    r = random.Random(2)
    rows = [(r.uniform(0, 3), r.choice([None, 1.0, r.random()])) for _ in range(200)] + [(7.5, None)]
    got = {x["bin"]: x for x in reports.bin_stats(spark.createDataFrame(rows, "x double, v double"), "x", "v").collect()}
    for b in range(3):
        v = [v for x, v in rows if v is not None and b < x <= b + 1]
        assert np.allclose([got[b][c] for c in ("q25", "median", "q75")], np.quantile(v, [0.25, 0.5, 0.75]))
    assert (got[7]["n"], got[7]["median"]) == (0, None)


def test_poisson_copies_are_a_bootstrap(spark):
    n = [r["n"] for r in spark.range(20000).select(sampling.poisson_copies("s", "id").alias("n")).collect()]
    assert abs(np.mean(n) - 1) < 0.03 and abs(np.var(n) - 1) < 0.05 and abs(np.mean(np.array(n) == 0) - math.exp(-1)) < 0.02


def test_simplified_silhouette_by_hand(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [10.0, 0.0]), (None, [1.0, 1.0])], "label int, px array<double>")
    got = {r["label"]: (r["n"], r["silhouette"]) for r in metrics.simplified_silhouette(df).collect()}
    assert got[1] == (1, 1.0) and got[0][0] == 2 and math.isclose(got[0][1], (9 / 10 + 7 / 8) / 2)
    assert metrics.simplified_silhouette(df.where("label = 1")).first()["silhouette"] is None


def plain_lloyd(v, centres, tol=1e-4, most=100):
    for _ in range(most):
        own = ((v[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.stack([v[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= tol:
            break
    d = np.sqrt(((v[:, None, :] - centres[None]) ** 2).sum(2))
    low = np.sort(d, axis=1)
    sil = np.where(low[:, 1] > 0, (low[:, 1] - low[:, 0]) / np.maximum(low[:, 1], 1e-300), 0).mean() if len(centres) > 1 else None
    return (low[:, 0] ** 2).sum(), sil


def test_fits_at_once_are_those_of_each_alone(spark, monkeypatch):
    r = np.random.default_rng(8)
    v = np.round(np.concatenate([r.normal(c, 0.4, (60, 5)) for c in (0, 1, 3)]), 4)
    df = spark.createDataFrame([(i, x.tolist(), "e") for i, x in enumerate(v)] + [(999, None, "e")], "id long, px array<double>, v string").repartition(5)
    fits = [(k, s) for k in (1, 2, 3, 7) for s in range(6)] + [(4, 11)]
    want = {}
    starts = clustering.seeds_rows(df.where("px is not null").select("id", "px"), "px", "id", [*range(6), 11], 7)
    for k, s in fits:
        want[k, s] = plain_lloyd(v, starts[s][:k].copy())
    for bound in (1 << 20, 700):
        monkeypatch.setattr(clustering, "CELLS", 100)
        got = clustering.Fits(df, "px", fits, bound=bound).run().result().collect()
        assert {(x["k"], x["seed"]) for x in got} == set(fits)
        for x in got:
            sse, sil = want[x["k"], x["seed"]]
            assert abs(x["sse"] - sse) < 1e-6 * sse and (sil is None or abs(x["silhouette"] - sil) < 1e-6), x
    labels, costs = clustering.kmeans(df, "px", 3, 6)
    kept = [c["seed"] for c in costs.collect() if c["kept"]]  # several starts may end alike
    assert len(kept) == 1 and abs(want[3, kept[0]][0] - min(want[3, s][0] for s in range(6))) < 1e-6
    assert labels.groupBy("cluster").count().count() == 3 and labels.count() == len(v)
    with pytest.raises(ValueError):
        clustering.Fits(df.limit(2), "px", [(4, 0)])


@pytest.mark.parametrize("spread", [0.01, 5.0])
def test_nearest_vectors_are_exact(spark, spread):
    from geogrid.operators import neighbours

    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(0, spread, (300, 4)) + c for c in r.uniform(-9, 9, (5, 4))] + [np.ones((200, 4))] * 2).round(4)  # a third are equal
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(-1, None)], "id long, px array<double>").repartition(6)
    got = neighbours.nearest_vectors(df, "px", 5, block=64).collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), n + 1) for i in range(len(v)) for n, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[:5])}
    assert {(x["id"], x["nid"], x["rank"]) for x in got} == want and len(got) == len(want)
    few = neighbours.nearest_vectors(df.where("id < 3"), "px", 5).collect()
    assert len(few) == 6
    assert neighbours.nearest_vectors(df.where("id = 1"), "px").count() == 0


def test_smote_balances_and_stays_between_neighbours(spark):
    rows = [(i, [float(i % 7), float(i // 7)], int(i < 20)) for i in range(83)]
    df = spark.createDataFrame(rows, "id long, px array<double>, label int")
    got = sampling.smote(df, "px").collect()
    assert len(got) == 83 - 2 * 20 and len({(r["id"], r["nth"]) for r in got}) == len(got)
    assert max(r["nth"] for r in got) == 2
    assert sampling.smote(df.where("id < 1 or id > 60"), "px").count() == 0
    assert sampling.smote(df.where("id < 30"), "px").count() == 0


def test_rasters_are_filled_each_from_its_own_pixels(spark):
    r = random.Random(2)
    rows = [("a", i // 12, i % 12, float(i % 5), r.random() < 0.2) for i in range(144)] + [("b", i // 12, i % 12, 100.0 + i % 5 if i > 100 else -999.0, r.random() < 0.2) for i in range(144)]
    rows += [("c", 0, 0, 7.0, False), ("c", 11, 11, 1.0, True), ("d", 3, 3, 1.0, True)]  # one source far away, none at all
    px = spark.createDataFrame(rows, "name string, row int, col int, value double, gap boolean")
    got = {(x["name"], x["row"], x["col"]): (x["n"], x["filled"]) for x in raster.idw_fill(px, k=3, raster="name").collect()}
    want = {}
    for name, row, col, _, gap in rows:
        near = sorted(((row - y) ** 2 + (col - x) ** 2, y, x, v) for n, y, x, v, g in rows if n == name and not g and v >= -100)[:3]
        if gap and near:
            want[name, row, col] = (len(near), sum(v / d for d, _, _, v in near) / sum(1 / d for d, _, _, _ in near))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_dense_squares_are_divided(spark):
    r = random.Random(9)
    a = [(i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(400)] + [(400 + i, 101 + r.random(), 99 + r.random()) for i in range(150)] + [(600 + i, 7.0, 7.0) for i in range(60)]
    b = [(i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(200)] + [(200 + i, 102.0, 100.0) for i in range(80)]
    left, right = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "bid int, bx double, by double")
    got = {(x["id"], x["bid"]) for x in spatial.within_distance(left, right, 20, most=16).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 400}
    sizes = spatial.in_squares(left, 20, 16).groupBy("__level", "__sx", "__sy", "__part").count()
    assert sizes.where("__level < 10").agg(F.max("count")).first()[0] <= 16 < 60
    assert sizes.agg(F.max("count")).first()[0] <= 40  # rows of one place go by a hash


def test_points_meet_edges_of_their_own_square_only(spark):
    r = random.Random(12)
    rings = []
    for p in range(5):
        cx, cy, n = r.uniform(20, 80), r.uniform(20, 80), r.randint(3, 40)
        for k in range(n):
            d = r.uniform(3, 45)
            rings.append((p, k, cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)))
    rings += [(9, 0, 10.0, 10.0), (9, 1, 60.0, 10.0), (9, 2, 60.0, 50.0), (9, 3, 10.0, 50.0)]
    points = [(i, r.uniform(-30, 130), r.uniform(-30, 130)) for i in range(1500)] + [(2000 + 13 * i + j, 10.0 * i, 10.0 * j) for i in range(13) for j in range(13)]
    want = set()
    for p in {x[0] for x in rings}:
        ring = [(x, y) for q, _, x, y in rings if q == p]
        for i, x, y in points:
            n = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
            if n % 2:
                want.add((i, p))
    r_df, p_df = spark.createDataFrame(rings, "poly_id int, seq int, x double, y double"), spark.createDataFrame(points, "id int, x double, y double")
    for size in (3.0, 10.0, 1000.0):
        assert {(x["id"], x["poly_id"]) for x in spatial.points_in_polygons(p_df, r_df, size).collect()} == want
    # A thin slanted edge touches few squares, however far its ring reaches to the left.
    long = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1000.0, 1.0), (1, 2, 1000.0, 101.0), (1, 3, 0.0, 101.0)], "poly_id int, seq int, x double, y double")
    right_side = spatial.ring_squares(long, 10.0).where("x1 = 1000 and x2 = 1000").count()
    assert right_side <= 13


def test_smoothing_by_ranges_is_that_of_the_whole(spark):
    v = np.random.default_rng(1).normal(size=130)
    w = np.array(timeline.kernel(5.0))
    for n in (130, 45, 7, 1):
        df = spark.createDataFrame([(i, float(v[i])) for i in range(n)], "t int, v double")
        mirrored = np.concatenate([v[:n], v[:n][::-1]])
        want = [sum(c * mirrored[(i + k - 20) % (2 * n)] for k, c in enumerate(w)) for i in range(n)]
        for rows in (1 << 16, 25, 8):
            got = [r["smoothed"] for r in timeline.smooth(df, "t", "v", rows=rows).orderBy("pos").collect()]
            assert np.allclose(got, want), (n, rows)


def test_quantiles_of_large_bins_are_exact(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(size=9000), np.full(6000, 0.25), np.round(r.normal(size=6000), 1)])
    lon = np.concatenate([np.full(15000, 3.5), r.uniform(0, 3, 6000)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, v, strict=True)] + [(3.5, None), (8.5, None)], "lon double, x double")
    for small in (10_000, 50_000):
        got = {x["bin"]: x for x in reports.bin_stats(df, "lon", "x", small=small).collect()}
        for b in range(4):
            own = v[np.ceil(lon) - 1 == b]
            assert got[b]["n"] == len(own)
            assert np.allclose([got[b]["median"], got[b]["q25"], got[b]["q75"]], np.quantile(own, [0.5, 0.25, 0.75]), atol=1e-12)
        assert got[8]["n"] == 0 and got[8]["median"] is None


def test_windows_of_a_year_follow_from_the_year(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, r.randint(-500, 900)) for i in range(300)] + [(999, None)], "id int, y int")
    w = spark.createDataFrame([(s, s + 300) for s in range(-450, 500, 50) if s % 200], "start int, end int")
    got = {(x["id"], x["start"]) for x in timeline.assign_windows(df, w, "y").collect()}
    assert got == {(x["id"], v["start"]) for x in df.collect() for v in w.collect() if x["y"] is not None and v["start"] <= x["y"] < v["end"]}
    assert timeline.assign_windows(df, w.limit(0), "y").count() == 0
    with pytest.raises(ValueError):
        timeline.assign_windows(df, w.unionByName(w.selectExpr("start", "end + 1 as end")), "y")
