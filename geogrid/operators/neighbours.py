"""The k nearest vectors of each vector, exact, from pivots and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import seeds_rows
from .storage import stored

PIVOTS, ROWS_A_PIVOT = 64, 256
BLOCK = 2048  # vectors of a block


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def _lists(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def in_cells(x: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, r): each vector with its nearest pivot and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lists(b.column("v"), b.num_rows), pivots)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], names=["id", "v", "cell", "r"])

    return x.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int, r double")


def in_blocks(cells: DataFrame, size: int) -> DataFrame:
    """(block, cell, low, high, ids, vs): up to ``size`` vectors of a cell that are about as far from its pivot.

    Cells are dealt by ranges of that distance, so a cell of any number of vectors is cut without being in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        made = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal made
            b = pa.concat_batches(kept)
            kept.clear()
            made += 1
            r, v = b.column("r"), _lists(b.column("v"), b.num_rows)
            values = (made, b.column("cell")[0], r[0], r[b.num_rows - 1], b.column("ids").to_numpy().tobytes(), v.tobytes())
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], k) for x, k in zip(values, kinds, strict=True)], names=["block", "cell", "low", "high", "ids", "vs"])

        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            at = 0
            while at < b.num_rows:
                if kept and (kept[0].column("cell")[0].as_py() != cell[at] or sum(k.num_rows for k in kept) == size):
                    yield block()
                room = size - sum(k.num_rows for k in kept)
                to = min(at + room, at + int(np.searchsorted(cell[at:], cell[at], "right")))
                kept.append(b.slice(at, to - at))
                at = to
        if kept:
            yield block()

    ordered = cells.select("cell", "r", F.col("id").alias("ids"), "v").repartitionByRange("cell", "r", "ids").sortWithinPartitions("cell", "r", "ids")
    return ordered.mapInArrow(run, "block long, cell int, low double, high double, ids binary, vs binary")


def _nearest(q: np.ndarray, q_ids: np.ndarray, s: np.ndarray, s_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest of ``s`` for each of ``q``, itself left out; ties go by id."""
    out = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d2 = (part * part).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2 * part @ s.T
        d2[q_ids[at : at + 256, None] == s_ids[None, :]] = np.inf
        slack = 1e-9 * ((part * part).sum(1) + (s * s).sum(1).max())
        most = min(k, len(s)) - 1
        bound = np.partition(d2, most, axis=1)[:, most] + slack
        i, j = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        exact = np.sqrt(((part[i] - s[j]) ** 2).sum(1))  # products may be off in the last digits
        order = np.lexsort((s_ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(part)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((i[keep] + at, s_ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_vectors(df: DataFrame, array: str, k: int = 5, key: str = "id", block: int = BLOCK) -> DataFrame:
    """(id, nid, rank, d): the ``k`` nearest other rows of each row by Euclidean distance, ties by id, rank from 1.

    Exact, by pivots. Each vector belongs to the cell of its nearest pivot; cells are cut into blocks by the distance
    from the pivot. How far the k-th neighbour can be is known before any search: it is no farther than in the
    vector's own block, and no farther than a pivot plus the (k + 1)-th smallest distance in that pivot's cell. So a
    block is compared with those blocks only whose cell, and within it whose distances from its pivot, the triangle
    inequality doesn't rule out. Pairs of blocks are what is dealt to tasks, so no cell or group of equal vectors is
    in one of them; near vectors of many dimensions rule out little, then all blocks meet.

    Rows without a vector are left out; ``key`` is unique; all of fewer than k other rows are returned.
    """
    x = stored(df.where(F.col(array).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(array).cast("array<double>").alias("v")), "vectors")
    n = x.count()
    schema = "id long, nid long, d double"
    if n < 2:
        return x.sparkSession.createDataFrame([], "id long, nid long, rank int, d double")
    pivots = seeds_rows(x, "v", "id", [0], max(1, min(PIVOTS, n // ROWS_A_PIVOT)))[0]
    cells = stored(in_cells(x, pivots), "cells")
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("r", "id"))
    inner = {r["cell"]: r["r"] for r in cells.select("cell", "r", nth.alias("nth")).where(F.col("nth") <= k + 1).where(F.col("nth") == k + 1).collect()}  # a row for each pivot
    outer = {r["cell"]: r["r"] for r in cells.groupBy("cell").agg(F.max("r").alias("r")).collect()}
    at_most = np.array([inner.get(c, np.inf) for c in range(len(pivots))])
    radius = np.array([outer.get(c, -np.inf) for c in range(len(pivots))])
    blocks = stored(in_blocks(cells, block), "blocks")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, cell, ids, vs in zip(*(b.column(c).to_pylist() for c in ("block", "cell", "ids", "vs")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(vs).reshape(len(ids), -1)
                i, _, d = _nearest(v, ids, v, ids, k)
                own = np.full(len(ids), np.inf)
                full = np.flatnonzero(np.bincount(i, minlength=len(ids)) == k)
                own[full] = np.maximum.reduceat(d, np.searchsorted(i, full))[: len(full)] if len(full) else own[full]
                to = _distances(v, pivots)
                far = np.minimum(own, (to + at_most).min(axis=1))
                far = far + 1e-6 * (1 + np.abs(v).max())
                near = (to - radius <= far[:, None]) & ((to - to[:, [cell]]) / 2 <= far[:, None])
                low, high = np.where(near, to - far[:, None], np.inf).min(0), np.where(near, to + far[:, None], -np.inf).max(0)
                some = np.flatnonzero(near.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name)), pa.array(some, pa.int32()), pa.array(low[some]), pa.array(high[some])], names=["q", "cell", "from", "to"])

    wants = blocks.select("block", "cell", "ids", "vs").mapInArrow(wanted, "q long, cell int, from double, to double")
    pairs = wants.join(blocks.select("cell", F.col("block").alias("s"), "low", "high"), "cell").where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("q").alias("block")), F.struct(F.lit(1).alias("side"), F.col("s").alias("block"))))
    rows = pairs.select("q", "s", sides.alias("x")).select("q", "s", "x.side", "x.block").join(blocks.select("block", "ids", "vs"), "block")

    def compare(pair: pa.Table) -> pa.Table:
        got = {r["side"]: r for r in pair.select(["side", "ids", "vs"]).to_pylist()}
        ids = {s: np.frombuffer(got[s]["ids"], np.int64) for s in got}
        v = {s: np.frombuffer(got[s]["vs"]).reshape(len(ids[s]), -1) for s in got}
        i, near, d = _nearest(v[0], ids[0], v[1], ids[1], k)
        return pa.table({"id": ids[0][i], "nid": near, "d": d})

    found = rows.groupBy("q", "s").applyInArrow(compare, schema)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "nid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "nid", "rank", "d")
