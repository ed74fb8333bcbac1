"""Raster operators on pixel tables (raster, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .spatial import dealt
from .storage import stored


def drop_nodata(px: DataFrame, floor: float = -100.0, value: str = "value") -> DataFrame:
    """Pixels at or above the floor; NaN, which Spark orders above all numbers, goes too."""
    return px.where((F.col(value) >= floor) & ~F.isnan(value))


def gap_mask(px: DataFrame, code: Column, value: str = "value") -> DataFrame:
    return px.withColumn("mask", (F.col(value) == code).cast("float"))


def to_calories(px: DataFrame, calories: DataFrame, value: str = "yield") -> DataFrame:
    """Yield times the crop's calories (crop, kcal); crops without them give null."""
    return px.join(calories, "crop", "left").withColumn("calories", F.col(value) * F.col("kcal"))


def idw_fill(px: DataFrame, k: int = 5, power: float = 2.0, exact: float = 1e-10, raster: str | None = None) -> DataFrame:
    """([raster,] row, col, n, filled) of the pixels marked ``gap``, from the k nearest valid ones of their raster weighed
    by 1 / distance^power; a source at the spot gives its value.

    With ``raster``, a column that names the raster, there can be any number of them, each with its own gaps and its
    own pixels without data. Their grid is one, so neighbours are looked for once for each place that is a gap
    anywhere: twice k of the places that have data anywhere. Where k of these have data in a raster, they are its
    nearest; only gaps that lack some are searched again among their raster's own pixels.
    """
    valid = px.where(~F.col("gap") & (F.col("value") >= -100))
    if raster is None:
        near, place = spatial.knn(px.where("gap"), valid.select("row", "col", "value"), k), ["row", "col"]
    else:
        place = [raster, "row", "col"]
        gaps = stored(px.where("gap").select(*place), "gaps")
        valid = stored(valid.select(*place, "value"), "valid")
        shared = spatial.knn(gaps, valid.select("row", "col").distinct().withColumn("value", F.lit(None).cast("double")), 2 * k)
        own = valid.select(raster, F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
        x = gaps.join(dealt(shared.drop("value", "rank")), ["row", "col"]).join(dealt(own), [raster, "srow", "scol"])
        nth = F.row_number().over(Window.partitionBy(*place).orderBy("d2", "srow", "scol"))
        x = stored(x.withColumn("rank", nth).where(F.col("rank") <= k).select(*place, "value", "d2"), "near")
        whole = stored(x.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") == k).select(*place), "whole")
        lacking = gaps.join(dealt(whole), place, "left_anti")
        more = spatial.knn(lacking, valid, k, by=(raster,)).select(*place, "value", "d2")
        near = x.join(dealt(whole), place, "left_semi").unionByName(more)
    d = F.sqrt("d2")
    w = 1 / F.pow(F.greatest(d, F.lit(exact)), F.lit(power))
    hit = F.max(F.when(d < exact, F.col("value")))
    x = near.groupBy(*place).agg(F.count("*").alias("n"), hit.alias("hit"), (F.sum(F.col("value") * w) / F.sum(w)).alias("mean"))
    return x.select(*place, "n", F.coalesce("hit", "mean").alias("filled"))


def zonal_mean(px: DataFrame, cells: DataFrame, empty: float | None = None, floor: float = -100.0) -> DataFrame:
    """(id, n, mean): mean of the valid pixels that touch each cell; ``empty`` for cells without one."""
    hit = spatial.pixels_in_cells(drop_nodata(px, floor), cells).groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    mean = F.col("mean") if empty is None else F.coalesce("mean", F.lit(empty))
    return cells.select("id").join(hit, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), mean.alias("mean"))


def native_crops(lists: DataFrame, columns: list[str]) -> DataFrame:
    """(continent, crop) from list columns, joined by commas and cut again; ``-`` stands for nothing."""
    every = F.explode(F.split(F.regexp_replace(F.concat_ws(",", *columns), r"\s", ""), ","))
    return lists.select("continent", every.alias("crop")).where("crop not in ('-', '')").distinct()


def best_crop(yields: DataFrame, ranks: DataFrame, land: DataFrame | None = None, native: DataFrame | None = None) -> DataFrame:
    """(row, col, crop_rank, best): the crop with the largest yield above 0; of equal ones the lowest rank.

    Land without a yield gives (0, -2); sea, where ``land`` (row, col, continent) has none, gives (-100, -1) and
    overrides. With ``native`` (continent, crop) only crops of the pixel's continent count.
    """
    x = yields.join(ranks, "crop")
    if land is not None:
        x = x.join(land, ["row", "col"], "left")
    counts = F.col("yield") > 0
    if native is not None:
        x = x.join(native.withColumn("native", F.lit(True)), ["continent", "crop"], "left")
        counts = counts & F.coalesce("native", F.lit(False))
    sea = F.max(F.col("continent").isNotNull()) == F.lit(False) if land is not None else F.lit(False)
    top = F.max(F.when(counts, F.struct(F.col("yield").alias("y"), (-F.col("rank")).alias("r"))))
    x = x.groupBy("row", "col").agg(top.alias("t"), sea.alias("sea"))
    return x.select(
        "row", "col",
        F.when(F.col("sea"), -100).otherwise(F.coalesce(-F.col("t.r"), F.lit(0))).cast("int").alias("crop_rank"),
        F.when(F.col("sea"), -1.0).otherwise(F.coalesce("t.y", F.lit(-2.0))).alias("best"),
    )


def clip(px: DataFrame, cells: DataFrame, h: int, w: int | None = None) -> DataFrame:
    """(id, h, w, px): windows of h x w pixels (w: as h) from cells' upper-left (row0, col0), rows and columns half-open.

    Cells may begin anywhere: each goes to the lattice squares of h x w that it overlaps, four at most, and takes the
    pixels of its own window there. A tile is put together in one row, as large as a tile; pixels that are missing
    are null in it. A cell without a pixel gives no tile.
    """
    w = w or h
    at = lambda c, n: F.floor(F.col(c) / n)
    keyed = px.select(at("row", h).alias("ty"), at("col", w).alias("tx"), "row", "col", "value")
    over = lambda c, n: F.explode(F.sequence(at(c, n), F.floor((F.col(c) + (n - 1)) / n)))
    c = cells.select("id", "row0", "col0", over("row0", h).alias("ty")).withColumn("tx", over("col0", w))
    r, k = F.col("row") - F.col("row0"), F.col("col") - F.col("col0")
    own = c.join(keyed, ["ty", "tx"]).where((r >= 0) & (r < h) & (k >= 0) & (k < w))
    got = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct((r * w + k).cast("int").alias("k"), "value"))).alias("m"))
    return got.select("id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.try_element_at("m", i)).alias("px"))


def tile_nodata(px: DataFrame, bio: Column, by: str = "id") -> DataFrame:
    """Tile pixels without data: other bands below -3000 or NaN become 0; bio bands below -100 get the tile's mean of
    values above -100, and a bio tile without one is dropped. A value of exactly -100 is neither."""
    w = Window.partitionBy(by)
    v = F.col("value")
    mean = F.avg(F.when(v > -100, v)).over(w)
    fixed = F.when(bio, F.when((v < -100) | F.isnan(v), F.col("__mean")).otherwise(v)).otherwise(F.when((v < -3000) | F.isnan(v), 0.0).otherwise(v))
    return px.withColumn("__mean", mean).where(~bio | F.col("__mean").isNotNull()).withColumn("value", fixed).drop("__mean")


def water(v: Column, threshold: float = 80.0) -> Column:
    return F.when(v > threshold, 255).otherwise(0)


def bilinear_weights(source: int, target: int) -> list[tuple[int, int, float]]:
    """(dst, src, weight) of a one-dimensional bilinear resize; the support widens when shrinking, weights sum to 1."""
    scale = source / target
    support = max(scale, 1.0)
    out = []
    for d in range(target):
        mid = (d + 0.5) * scale
        lo, hi = max(0, int(mid - support + 0.5)), min(source, int(mid + support + 0.5))
        w = [max(0.0, 1 - abs((s + 0.5 - mid) / support)) for s in range(lo, hi)]
        out += [(d, s, x / sum(w)) for s, x in zip(range(lo, hi), w, strict=True) if x]
    return out


def resize(px: DataFrame, source: int, target: int, key: str = "id") -> DataFrame:
    """(key, row, col, value) resized bilinearly, first along columns, then along rows; the weights are two small tables."""
    weights = px.sparkSession.createDataFrame(bilinear_weights(source, target), "d int, s int, w double")
    cols = px.join(F.broadcast(weights), F.col("col") == F.col("s")).groupBy(key, "row", F.col("d").alias("c")).agg(F.sum(F.col("w") * F.col("value")).alias("v"))
    return cols.join(F.broadcast(weights), F.col("row") == F.col("s")).groupBy(key, F.col("d").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def stack(bands: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tiles (id, year, band, px) as one row with all bands in the order of ``names``, and the (id, year, missing) that lack some."""
    x = bands.groupBy("id", "year").pivot("band", names).agg(F.first("px"))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"`{n}`").isNotNull()
    full = x.where(whole).select("id", "year", F.array(*[F.col(f"`{n}`") for n in names]).alias("px"))
    lacking = F.filter(F.array(*[F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in names]), lambda v: v.isNotNull())
    return full, x.where(~whole).select("id", "year", lacking.alias("missing"))
