"""Spatial joins as equi-joins on buckets of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SHIFT = 0.3819660112501051  # where the corners of squares lie, as a part of a square
MOST, DEEPEST = 4096, 10  # rows of a square, and how often one can be divided in four


def _square(level: Column, size: float) -> tuple[Column, Column]:
    return F.floor(F.col("x") * F.pow(F.lit(2.0), level) / size), F.floor(F.col("y") * F.pow(F.lit(2.0), level) / size)


def in_squares(a: DataFrame, size: float, most: int = MOST) -> DataFrame:
    """``a`` (id, x, y, ...) with __level, __sx, __sy, __part, __parts: the square of a quadtree that a row is in.

    Squares of ``size`` are divided in four while they hold more than ``most`` rows. What is as dense after DEEPEST
    steps, such as rows of one place, is dealt over parts. Only rows of dense squares are looked at again.
    """
    sx, sy = _square(F.lit(0), size)
    x, on = a.withColumns({"__level": F.lit(0), "__sx": sx, "__sy": sy}), ["__level", "__sx", "__sy"]
    dense = stored(x.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most), "dense")
    for level in range(DEEPEST):
        if dense.isEmpty():
            break
        x = x.join(dense.withColumnRenamed("__n", "__dense"), on, "left")
        down = F.col("__dense").isNotNull()
        dx, dy = _square(F.lit(level + 1), size)
        x = x.withColumns({"__level": F.when(down, level + 1).otherwise(F.col("__level")), "__sx": F.when(down, dx).otherwise(F.col("__sx")), "__sy": F.when(down, dy).otherwise(F.col("__sy"))}).drop("__dense")
        x = stored(x, "squares")
        dense = stored(x.where(F.col("__level") == level + 1).groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most), "dense")
    if dense.isEmpty():
        return x.withColumns({"__part": F.lit(0).cast("long"), "__parts": F.lit(1).cast("long")})
    parts = dense.select(*on, F.ceil(F.col("__n") / most).alias("__parts"))
    x = x.join(parts, on, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
    return x.withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")))


def within_distance(a: DataFrame, b: DataFrame, radius: float, most: int = MOST) -> DataFrame:
    """Pairs of ``a`` (id, x, y) and ``b`` (bid, bx, by) at most ``radius`` apart, with all columns and ``d``.

    ``a`` is in the squares of a quadtree, see ``in_squares``, so no square has more than ``most`` rows of it. Each
    row of ``b`` goes to those squares that are within the radius, so a pair meets in exactly one; where many rows of
    ``b`` go to one square, they are dealt over parts of ``most``, and its rows of ``a`` go to each.
    """
    left = stored(in_squares(a, radius, most), "squares")
    on = ["__level", "__sx", "__sy", "__part"]
    squares = left.select("__level", "__sx", "__sy", "__parts").distinct()
    side = F.lit(float(radius)) / F.pow(F.lit(2.0), F.col("__level"))
    squares = squares.withColumns({"__x": F.col("__sx") * side, "__y": F.col("__sy") * side, "__side": side})
    whole = F.pow(F.lit(2.0), F.col("__level"))
    squares = squares.withColumns({"__gx": F.floor(F.col("__sx") / whole), "__gy": F.floor(F.col("__sy") / whole)})
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = b.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step))
    right = right.withColumn("__gx", F.floor(F.col("bx") / radius) + F.col("__dx")).withColumn("__gy", F.floor(F.col("by") / radius) + F.col("__dy")).drop("__dx", "__dy")
    digit = lambda v, low: 1e-14 * (F.abs(v) + F.abs(low) + F.col("__side"))
    gap = lambda v, low: F.greatest(F.lit(0.0), F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(low) - F.col("__side")) - digit(v, low))
    reach = gap("bx", "__x") * gap("bx", "__x") + gap("by", "__y") * gap("by", "__y") <= radius * radius * (1 + 1e-12)
    right = right.join(squares, ["__gx", "__gy"]).where(reach).drop("__x", "__y", "__side", "__gx", "__gy")
    right = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    crowds = stored(right.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*on, F.ceil(F.col("__n") / most).alias("__crowd")), "crowds")
    left = left.drop("__parts")
    if not crowds.isEmpty():
        one = F.coalesce("__crowd", F.lit(1).cast("long"))
        right = right.join(crowds, on, "left").withColumn("__to", F.pmod(F.xxhash64("bid"), one)).drop("__crowd")
        left = left.join(crowds, on, "left").withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("__crowd")
        on = [*on, "__to"]
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    pairs = left.join(right, on).drop(*on).withColumn("__d2", dx * dx + dy * dy)
    return pairs.where(F.col("__d2") <= radius * radius).withColumn("d", F.sqrt("__d2")).drop("__d2")


def neighbour_counts(cells: DataFrame, towns: DataFrame, bands: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """(id, year, n_<band> ...): towns that exist in a year within each distance of a cell, for every founding year.

    One join at the largest distance gives each pair two events: the town counts from the first founding year after its
    own on, and no more from the first that is not before its end. Events are summed by cell and year before a running total, so a pair is not
    repeated for each year that the town lasts. Years are the distinct founding years, a bounded list. Cells without
    a neighbour in a year have no row, and towns without a founding or last year count nowhere.
    """
    from pyspark.sql import Window

    b = towns.where("birth is not null and end_yr is not null")
    marks = towns.select(F.col("birth").alias("year"), F.lit(1).alias("founded")).unionByName(b.select(F.col("end_yr").alias("year"), F.lit(0).alias("founded")))
    marks = marks.where("year is not null").groupBy("year").agg(F.max("founded").alias("founded"))
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row for each year there is
    marks = marks.withColumn("before", F.coalesce(F.sum("founded").over(before), F.lit(0)).cast("int"))
    years = [r["year"] for r in marks.where("founded = 1").orderBy("year").collect()]
    since = marks.select(F.col("year").alias("birth"), (F.col("before") + 1).alias("since"))
    until = marks.select(F.col("year").alias("end_yr"), F.col("before").alias("until"))
    b = b.join(since, "birth").join(until, "end_yr").where("since < until").select(F.col("city_id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"), "since", "until")
    near = within_distance(cells.select("id", "x", "y"), b, max(bands)).select("id", "since", "until", "d")
    turn = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("by")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("by"))))
    events = near.select("id", "d", turn.alias("e"))
    names = [f"n_{r}" for r in bands]
    steps = events.groupBy("id", F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("d") <= r, F.col("e.by")).otherwise(0)).alias(n) for r, n in zip(bands, names, strict=True)])
    order = Window.partitionBy("id").orderBy("at")  # at most one event for each year there is
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.select("id", "at", F.lead("at").over(order).alias("next"), *[F.sum(n).over(run).alias(n) for n in names])
    lasting = state.where(F.col(f"n_{max(bands)}") > 0).select("id", F.explode(F.sequence("at", F.col("next") - 1)).alias("at"), *names)
    return lasting.select("id", F.element_at(F.lit(years).cast("array<int>"), F.col("at") + 1).alias("year"), *names)


def edges(rings: DataFrame) -> DataFrame:
    """(poly_id, x1, y1, x2, y2) from rings (poly_id, seq, x, y), closed."""
    from pyspark.sql import Window

    w = Window.partitionBy("poly_id").orderBy("seq")
    every = Window.partitionBy("poly_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    return rings.select("poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def ring_squares(rings: DataFrame, size: float = 10.0) -> DataFrame:
    """(poly_id, gx, gy, x1, y1, x2, y2): squares of rings. A row with an edge is a square that the edge touches; one
    without is a square whose lower left corner is inside the ring.

    Corners lie at ``SHIFT`` of a square, so that rings of round coordinates have none on an edge. On each line of
    corners the edges that cross it are gone through from the right: after an odd number of them corners are inside.
    """
    from pyspark.sql import Window

    at = lambda v: F.floor(v / size - SHIFT)
    e = edges(rings)
    slack = 1e-9
    across = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    t = e.withColumn("gy", F.explode(F.sequence(at(low - slack * size), at(high + slack * size))))
    line = (F.col("gy") + SHIFT) * size
    inside = lambda y: F.least(F.greatest(y, low), high)
    a, z = (F.coalesce(across(inside(y)), F.col(c)) for y, c in ((line, "x1"), (line + size, "x2")))
    touched = t.withColumn("gx", F.explode(F.sequence(at(F.least(a, z) - slack * size), at(F.greatest(a, z) + slack * size))))
    crossing = t.where((F.col("y1") > line) != (F.col("y2") > line)).select("poly_id", "gy", (F.ceil(across(line) / size - SHIFT) - 1).alias("last"))
    order = Window.partitionBy("poly_id", "gy").orderBy(F.desc("last"))
    runs = crossing.withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("last").over(order)).where("nth % 2 = 1 and next < last")
    full = runs.select("poly_id", F.explode(F.sequence(F.col("next") + 1, F.col("last"))).alias("gx"), "gy")
    return touched.select("poly_id", "gx", "gy", "x1", "y1", "x2", "y2").unionByName(full, allowMissingColumns=True)


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float = 10.0) -> DataFrame:
    """(id, poly_id) of points (id, x, y) inside rings, as the parity of edges that a ray to the right crosses tells.

    A point meets its own square's rows of ``ring_squares`` alone: where no edge touches it, the corner tells. Else
    the parity changes with each edge between point and corner, along the point's row to the square's left side and
    down that side to the corner. An edge that touches two rows of points' y counts for the half-open range [low, high).
    """
    p = points.select("id", "x", "y", F.floor(F.col("x") / size - SHIFT).alias("gx"), F.floor(F.col("y") / size - SHIFT).alias("gy"))
    left, bottom = (F.col("gx") + SHIFT) * size, (F.col("gy") + SHIFT) * size
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x_there = dx * (F.col("y") - F.col("y1")) / dy + F.col("x1")
    y_there = dy * (left - F.col("x1")) / dx + F.col("y1")
    row = F.when((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")), ((x_there > left) & (x_there <= F.col("x"))).cast("int")).otherwise(0)
    down = F.when((F.col("x1") > left) != (F.col("x2") > left), ((y_there > bottom) & (y_there <= F.col("y"))).cast("int")).otherwise(0)
    n = F.when(F.col("x1").isNull(), 1).otherwise(row + down)
    met = p.join(ring_squares(rings, size), ["gx", "gy"]).groupBy("id", "poly_id").agg(F.sum(n).alias("n"))
    return met.where("n % 2 = 1").select("id", "poly_id")


def last_polygon(points: DataFrame, rings: DataFrame, outside: int = -1) -> DataFrame:
    """(id, poly_id): of the polygons that a point is in the last one, ``outside`` if in none."""
    inside = points_in_polygons(points, rings).groupBy("id").agg(F.max("poly_id").alias("poly_id"))
    return points.select("id").join(inside, "id", "left").select("id", F.coalesce("poly_id", F.lit(outside)).alias("poly_id"))


def boxes_in_polygons(boxes: DataFrame, rings: DataFrame, half: float = 0.5) -> DataFrame:
    """(id, poly_id) of boxes of half width ``half`` around (x, y) that lie wholly inside a ring.

    All four corners are inside, and no ring edge enters the box.
    """
    corners = F.explode(F.array(*[F.struct((F.col("x") + sx * half).alias("cx"), (F.col("y") + sy * half).alias("cy"), F.lit(k).alias("k")) for k, (sx, sy) in enumerate(((-1, -1), (-1, 1), (1, -1), (1, 1)))]))
    c = boxes.select(F.col("id").alias("box"), corners.alias("c")).select(F.struct("box", "c.k").alias("id"), F.col("c.cx").alias("x"), F.col("c.cy").alias("y"))
    whole = points_in_polygons(c, rings).groupBy(F.col("id.box").alias("id"), "poly_id").agg(F.count("*").alias("n")).where("n = 4")
    size = 10.0
    squares = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    e = edges(rings).withColumn("__gy", squares(F.least("y1", "y2"), F.greatest("y1", "y2"))).withColumn("__gx", squares(F.least("x1", "x2"), F.greatest("x1", "x2")))
    b = boxes.select("id", "x", "y").withColumn("__gy", squares(F.col("y") - half, F.col("y") + half)).withColumn("__gx", squares(F.col("x") - half, F.col("x") + half))
    left, right, bottom, top = F.col("x") - half, F.col("x") + half, F.col("y") - half, F.col("y") + half
    # The part of the edge's parameter range that is inside the box, slab by slab.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lo = lambda p, d, a, z: F.when(d == 0, F.when((p > a) & (p < z), 0.0).otherwise(2.0)).otherwise(F.least(F.try_divide(a - p, d), F.try_divide(z - p, d)))
    hi = lambda p, d, a, z: F.when(d == 0, F.when((p > a) & (p < z), 1.0).otherwise(-1.0)).otherwise(F.greatest(F.try_divide(a - p, d), F.try_divide(z - p, d)))
    first = F.greatest(F.lit(0.0), lo(F.col("x1"), dx, left, right), lo(F.col("y1"), dy, bottom, top))
    last = F.least(F.lit(1.0), hi(F.col("x1"), dx, left, right), hi(F.col("y1"), dy, bottom, top))
    cut = b.join(e, ["__gx", "__gy"]).where(first < last).select("id", "poly_id").distinct()
    return whole.join(cut, ["id", "poly_id"], "left_anti").select("id", "poly_id")


def pixels_in_cells(pixels: DataFrame, cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Pixels (row, col, ...) that touch cells (id, minx, miny, maxx, maxy): pixel (r, c) is the square [c, c+1) x [r, r+1) times ``size``.

    A cell is dealt to the lattice squares of 16 pixels that it overlaps and meets their pixels there; touching an
    edge from outside is not an overlap.
    """
    tile = 16 * size
    low, high = lambda c: F.floor(F.col(c) / tile), lambda c: F.ceil(F.col(c) / tile) - 1
    c = cells.withColumn("__tx", F.explode(F.sequence(low("minx"), F.greatest(low("minx"), high("maxx"))))).withColumn("__ty", F.explode(F.sequence(low("miny"), F.greatest(low("miny"), high("maxy")))))
    p = pixels.withColumn("__tx", F.floor(F.col("col") / 16)).withColumn("__ty", F.floor(F.col("row") / 16))
    px, py = F.col("col") * size, F.col("row") * size
    touch = (px < F.col("maxx")) & (px + size > F.col("minx")) & (py < F.col("maxy")) & (py + size > F.col("miny"))
    return c.join(p, ["__tx", "__ty"]).where(touch).drop("__tx", "__ty")


def dealt(x: DataFrame) -> DataFrame:
    """One side of a join that is never sent whole to the driver and all tasks. Stored rows and columns of a raster take a
    few bytes a pixel, so their files seem small enough for it, but in memory they are some 80 times as large."""
    return x.hint("merge")


def knn(targets: DataFrame, sources: DataFrame, k: int = 5, reach: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, row, col, srow, scol, value, d2, rank): the k nearest sources of each target in pixel index space; ties by
    row and column. Targets and sources meet within the same values of ``by`` only, such as a raster's name.

    Targets search the buckets of ``reach`` pixels around them. A target is done when it has k sources within the
    distance that its search covers for sure; the others go on with twice the reach. Rounds are bounded by the
    raster's extent, after which whatever there is is taken.
    """
    from pyspark.sql import Window

    place = [*by, "row", "col"]
    span = sources.agg(F.max(F.greatest(F.abs("row"), F.abs("col"))).alias("m")).first()["m"] or 0
    most = targets.agg(F.max(F.greatest(F.abs("row"), F.abs("col"))).alias("m")).first()["m"] or 0
    s = sources.select(*by, F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
    todo, found = targets.select(*place).distinct(), None
    while True:
        t = todo.withColumn("__dx", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("__dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
        t = t.select(*place, (F.floor(F.col("row") / reach) + F.col("__dy")).alias("__gy"), (F.floor(F.col("col") / reach) + F.col("__dx")).alias("__gx"))
        b = s.withColumn("__gy", F.floor(F.col("srow") / reach)).withColumn("__gx", F.floor(F.col("scol") / reach))
        dr, dc = F.col("row") - F.col("srow"), F.col("col") - F.col("scol")
        x = t.join(dealt(b), [*by, "__gy", "__gx"]).select(*place, "srow", "scol", "value", (dr * dr + dc * dc).cast("double").alias("d2"))
        x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("d2", "srow", "scol"))).where(F.col("rank") <= k)
        x = stored(x, "knn")
        last = reach > span + most
        if not last:
            done = x.groupBy(*place).agg(F.count("*").alias("n"), F.max("d2").alias("m")).where((F.col("n") == k) & (F.col("m") <= float(reach * reach)))
            done = stored(done.select(*place), "done")
            x, todo = x.join(dealt(done), place, "left_semi"), stored(todo.join(dealt(done), place, "left_anti"), "todo")
        found = x if found is None else found.unionByName(x)
        if last or todo.isEmpty():
            return found
        reach *= 2


def cell_bounds(x: str = "x", y: str = "y", half: float = 0.5) -> Column:
    """A square cell's struct<minx,miny,maxx,maxy>."""
    return F.struct((F.col(x) - half).alias("minx"), (F.col(y) - half).alias("miny"), (F.col(x) + half).alias("maxx"), (F.col(y) + half).alias("maxy"))
