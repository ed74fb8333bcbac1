"""The prefix trie of conversations, from matrices of turn ids that are sorted shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ID = 16  # bytes of a turn's id
CELLS = 1 << 21  # of a padded matrix
SHARD = 16 << 20  # bytes of turn ids that a shard has on average, at most
ROWS = 1 << 14  # of a returned batch
HEAD, BLOCK = 6, 100  # heads are shorter than HEAD turns; BLOCK conversations share one
U = np.uint64

NODE = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
# What a shard returns: nodes that are its own; paths that go on in other shards, with what is known of each of their
# nodes; conversations that end on such a path; and, of the last step, the nodes of each shard's paths.
OWN, PATH, END, KNOWN = range(4)
PARTIAL = ("count", "first", "children", "leaves", "saved")
NONE = hashlib.sha256(b"").hexdigest()
PART = ", ".join(
    ["kind int", *[f"{c} {t}" for c, t in NODE.items()], "shard int, side int, path binary, lens array<int>", *[f"p_{c} array<long>" for c in PARTIAL]]
)


def turn_id(role: Column, text: Column) -> Column:
    """32 hexadecimal digits for a turn; the first bit is set, so that no id is zero and zeros can pad."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.lit("8"), F.substring(digest, 1, 31))


def paths(turns: DataFrame, rebuild: bool = False) -> DataFrame:
    """Per conversation: conv_id, path (the ids of its turns, one after the other), lens (their code points).

    Turns are in order of ``turn``, null first, of equal ones in order of role and id. One shuffle brings the
    conversations of a block of BLOCK ids together; with ``rebuild`` each begins with the first turns of the block's
    first conversation. Only ids and lengths are shuffled, no texts. A conversation is one row of some 24 bytes a
    turn.
    """
    role = F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        (F.col("conv_id") - F.col("conv_id") % BLOCK).cast("long").alias("base"),
        F.struct("turn", role.alias("role"), turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).alias("t"),
    )
    each = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["n"].alias("n")))
    convs = rows.repartition("base").groupBy("base", "conv_id").agg(each.alias("turns"))
    if rebuild:
        of_base = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEAD - 1))
        head = F.coalesce(F.max(of_base).over(Window.partitionBy("base")), F.slice("turns", 1, 0))
        h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")
        own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
        convs = convs.withColumn("turns", F.concat(F.slice(head, F.lit(1), h), own))
    return convs.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.n").alias("lens"))


class Matrix:
    """Rows of turn ids in order of their paths, with the number of leading turns that each shares with the row before."""

    def __init__(self, blobs: list[bytes], ties: np.ndarray):
        self.sizes = np.array([len(b) // ID for b in blobs], np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        self.ids = np.frombuffer(b"".join(blobs), ">u8").astype(U).reshape(-1, 2)
        m = len(blobs)
        # Where a row stands among the others so far, and what it shares with its neighbour in the end.
        rank, strips, at = np.zeros(m, np.int64), [], 0
        alive = np.flatnonzero(self.sizes > 0)
        while len(alive):
            width = int(min(max(4, CELLS // (2 * len(alive))), 16 << len(strips), self.sizes[alive].max() - at))
            padded = self._padded(alive, at, width)
            order = np.lexsort([*padded.reshape(len(alive), -1).T[::-1], rank[alive]])
            change = np.logical_or.accumulate((padded[order][1:] != padded[order][:-1]).any(axis=2), axis=1)
            other = rank[alive][order]
            new = np.concatenate(([True], (other[1:] != other[:-1]) | change[:, -1]))
            strips.append((at, width))
            # Rows that end before this strip come first in their rank.
            below = np.zeros(m, np.int64)
            below[alive[order]] = new.cumsum()
            whole = np.lexsort((below, rank))
            step = (rank[whole][1:] != rank[whole][:-1]) | (below[whole][1:] != below[whole][:-1])
            rank[whole] = np.concatenate(([0], step.cumsum()))
            at += width
            alive = np.flatnonzero(self.sizes > at)
        self.order = np.lexsort((ties, rank))
        self.sizes, self.starts = self.sizes[self.order], self.starts[self.order]
        self.shared = self._shared(strips)

    def _padded(self, rows: np.ndarray, at: int, width: int) -> np.ndarray:
        """Turns ``at`` to ``at + width`` of the rows, (rows, width, 2), zeros where there is none."""
        column = at + np.arange(width)
        has = column[None, :] < self.sizes[rows][:, None]
        out = np.zeros((len(rows), width, 2), U)
        out[has] = self.ids[(self.starts[rows][:, None] + column[None, :])[has]]
        return out

    def _shared(self, strips: list[tuple[int, int]]) -> np.ndarray:
        """Changes of a column accumulate from left to right; what comes before the first is shared."""
        m, shared = len(self.sizes), np.zeros(len(self.sizes), np.int64)
        going = np.arange(1, m)
        for at, width in strips:
            if not len(going):
                break
            for part in np.split(going, range(max(1, CELLS // (2 * width)), len(going), max(1, CELLS // (2 * width)))):
                change = np.logical_or.accumulate((self._padded(part, at, width) != self._padded(part - 1, at, width)).any(axis=2), axis=1)
                shared[part] += (~change).sum(axis=1)
            going = going[(shared[going] == at + width) & (np.minimum(self.sizes[going], self.sizes[going - 1]) > at + width)]
        shared = np.minimum(shared, self.sizes)
        shared[1:] = np.minimum(shared[1:], self.sizes[:-1])
        return shared


def _batches(columns: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of some ROWS rows from dicts of equally long columns; columns that one lacks are null."""
    kept, n = [], 0
    for found in columns:
        size = len(found["kind"])
        kept.append(pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(size, f.type) for f in schema], schema=schema))
        n += size
        if n >= ROWS:
            yield pa.concat_batches(kept)
            kept, n = [], 0
    if kept:
        yield pa.concat_batches(kept)


def nodes(
    matrix: Matrix, lens: np.ndarray, values: Callable[[str, np.ndarray, int], np.ndarray], ends: np.ndarray | None, whole: bool
) -> Iterator[dict]:
    """The nodes of a matrix' trie, from the deepest to the root, as columns of PART.

    ``lens`` has the code points of each turn in the order of ``matrix.ids``; ``values(name, rows, depth)`` tells what
    rows add to their node of that depth; ``ends`` has the rows' conversations, or is None. Rows of a node stand next
    to each other, so each depth is aggregated at once, by reduceat from one node's first row to the next one's. What
    lies below is summed up in the rows.

    Unless ``whole``, nodes on the first and the last row's path may have members in other shards. They are returned
    last, as PATH: for each node what is known of it, apart from what lies below the next node of the path.
    """
    m, sizes, shared = len(matrix.sizes), matrix.sizes, matrix.shared
    leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    rising = np.sort(sizes)
    # What both paths share, to this depth, is told by the first.
    common = int(min(shared[1:].min(initial=sizes[0]), sizes[0], sizes[-1]))
    open_paths = [] if whole else [(0, 0, 0), (1, m - 1, common + 1)][: 1 + (m > 1)]
    known = {side: {c: np.zeros(sizes[row] + 1, np.int64) for c in PARTIAL} for side, row, _ in open_paths}
    for _, part in known.items():
        part["first"][:] = np.iinfo(np.int64).max
    deeper: tuple[np.ndarray, dict] | None = None
    for depth in range(int(rising[-1]), -1, -1):
        rows = np.sort(by_size[: m - int(np.searchsorted(rising, depth, "left"))])
        begin = shared[rows] < depth
        begin[0] = True
        first = np.flatnonzero(begin)  # of each node the place of its first row
        node = begin.cumsum() - 1  # of each row its node
        n_convs = np.add.reduceat(values("count", rows, depth), first)
        conv_id = np.minimum.reduceat(values("first", rows, depth), first)
        n_children = np.add.reduceat(values("children", rows, depth), first)
        of_path = {side: int(node[np.searchsorted(rows, row)]) for side, row, since in open_paths if since <= depth <= sizes[row]}
        if deeper is not None:
            parent = node[np.searchsorted(rows, deeper[0])]
            n_children = n_children + np.bincount(parent, minlength=len(first))
            side = np.full(len(parent), -1)
            for s, k in of_path.items():
                side[parent == k] = s
            told = side < 0
            if told.any():
                yield {c: v[told] for c, v in deeper[1].items()} | {"parent_conv_id": conv_id[parent[told]]}
            if not told.all():
                yield {c: v[~told] for c, v in deeper[1].items()} | {"side": side[~told]}
        closed = np.setdiff1d(np.arange(len(first)), list(of_path.values()))
        last = lens[matrix.starts[rows[first]] + depth - 1] if depth else np.zeros(len(first), np.int64)
        leaves[rows] += values("leaves", rows, depth)
        saved[rows] += values("saved", rows, depth)
        leaves[rows[first[closed]]] += n_children[closed] == 0
        saved[rows[first[closed]]] += ((n_convs - 1) * last)[closed]
        n_leaves, saved_tokens = np.add.reduceat(leaves[rows], first), np.add.reduceat(saved[rows], first)
        here = np.flatnonzero(sizes[rows] == depth)
        for s, k in of_path.items():
            for c, v in zip(PARTIAL, (n_convs, conv_id, n_children, n_leaves, saved_tokens), strict=True):
                known[s][c][depth] = v[k]
            inside = rows[node == k]
            leaves[inside] = saved[inside] = 0
            if ends is not None and len(gone := rows[here[node[here] == k]]):
                yield {"kind": np.full(len(gone), END), "conv_id": ends[gone], "depth": np.full(len(gone), depth), "side": np.full(len(gone), s)}
        found = {
            "kind": np.full(len(closed), OWN), "conv_id": conv_id[closed], "depth": np.full(len(closed), depth), "n_convs": n_convs[closed],
            "n_children": n_children[closed], "n_leaves": n_leaves[closed], "saved_tokens": saved_tokens[closed],
        }
        if ends is not None:
            digests = np.full(len(first), NONE, object)
            cuts = np.flatnonzero(node[here][1:] != node[here][:-1]) + 1
            for members in np.split(here, cuts) if len(here) else ():
                digests[node[members[0]]] = hashlib.sha256(",".join(map(str, ends[rows[members]].tolist())).encode()).hexdigest()
            found["ends_sha256"] = digests[closed]
        deeper = rows[first[closed]], found
        if whole:
            yield {"kind": np.full(len(rows), KNOWN), "conv_id": conv_id[node], "depth": np.full(len(rows), depth), "row": rows}
    if deeper is not None and len(deeper[0]):
        yield deeper[1]
    for side, row, _ in open_paths:
        at, n = matrix.starts[row], sizes[row]
        turns = {"path": [matrix.ids[at : at + n].astype(">u8").tobytes()], "lens": [lens[at : at + n]]}
        yield {"kind": [PATH], "side": [side]} | turns | {f"p_{c}": [v] for c, v in known[side].items()}


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy().astype(np.int64)


def in_shards(convs: DataFrame, shards: int) -> DataFrame:
    """Each shard's own nodes, and its first and last path, of conversations (conv_id, path, lens) dealt by ranges of paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        ids = t.column("conv_id").to_numpy()
        matrix = Matrix(t.column("path").to_pylist(), ids)
        ids = ids[matrix.order]
        given = {"count": lambda rows: np.ones(len(rows), np.int64), "first": lambda rows: ids[rows]}
        values = lambda c, rows, _: given[c](rows) if c in given else np.zeros(len(rows), np.int64)
        shard = TaskContext.get().partitionId()
        found = nodes(matrix, _flat(t.column("lens")), values, ids, whole=False)
        yield from _batches(({**f, "shard": np.full(len(f["kind"]), shard)} for f in found), _schema())

    return convs.repartitionByRange(shards, "path", "conv_id").mapInArrow(run, PART)


def recombined(parts: DataFrame) -> DataFrame:
    """The nodes that several shards may share, from all shards' PATH rows, and as KNOWN which node each one's is.

    These are two paths a shard, of some 70 bytes a turn, whatever number of conversations a shard has; one task
    takes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        shard, side = t.column("shard").to_numpy(), t.column("side").to_numpy()
        matrix = Matrix(t.column("path").to_pylist(), 2 * shard.astype(np.int64) + side)
        flat = {c: _flat(t.column(f"p_{c}")) for c in PARTIAL}
        places = matrix.starts + matrix.order  # a row has a value more than it has turns
        found = nodes(matrix, _flat(t.column("lens")), lambda c, rows, depth: flat[c][places[rows] + depth], None, whole=True)
        named = ({**f, "shard": shard[at := matrix.order[f["row"]]], "side": side[at]} if "row" in f else f for f in found)
        yield from _batches(named, _schema())

    paths = parts.where(F.col("kind") == PATH).select("shard", "side", "path", "lens", *[f"p_{c}" for c in PARTIAL])
    return paths.repartition(1).mapInArrow(run, PART)


def _schema() -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, types[kind]) for name, kind in (f.rsplit(" ", 1) for f in PART.split(", "))])


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from rows (conv_id, depth, member): members stream by in order, none are kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            conv_id, depth, member = (b.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
            cuts = [0, *(np.flatnonzero((conv_id[1:] != conv_id[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), b.num_rows]
            done = []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                listed = ",".join(map(str, member[start:stop].tolist())).encode()
                if (this := (int(conv_id[start]), int(depth[start]))) == key:
                    state.update(b"," + listed)
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = this, hashlib.sha256(listed)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, state.hexdigest()), schema, strict=True)], schema=schema)

    ordered = ends.select("conv_id", "depth", "member").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, rebuild: bool = False) -> DataFrame:
    """Per node of the trie of conversations (conv_id, turn, role, text): the columns of NODE.

    A node of depth d is a distinct sequence of first d turns (role, text); the root has none. ``conv_id`` is its
    smallest member, ``n_convs`` counts its members, ``n_leaves`` the childless nodes of its subtree (itself, if it is
    one), ``saved_tokens`` sums over the subtree (members - 1) times the code points of a node's last text, and
    ``ends_sha256`` is the digest of the ids of the members that end there, in order, with commas between.

    Conversations are dealt to shards by ranges of their turns' ids. Within a shard the padded matrix of turn ids is
    sorted, some columns at a time, and all depths are aggregated. A node that several shards share is on the first
    or the last path of each; those alone are put together in the end. So a first turn, or a whole conversation,
    that a third of all conversations have is spread over shards; only the ids of conversations that are equal as a
    whole go to one task, which hashes them as they stream by.

    Turns of equal ``turn`` are in order of role and of a digest of both; rows that repeat are turns of their own.
    Null roles and texts count as empty, a null conv_id is no conversation. Texts of any length are one id; a
    conversation is one row of 24 bytes a turn. An empty table gives no rows, not even a root. Other columns are not
    looked at, whatever they are called.
    """
    convs = stored(paths(turns, rebuild), "paths")
    total = convs.agg(F.coalesce(F.sum(F.length("path")), F.lit(0))).first()[0]
    shards = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    parts = stored(in_shards(convs, shards), "parts")
    top = stored(recombined(parts), "top")
    known = top.where(F.col("kind") == KNOWN).select("shard", "side", "depth", F.col("conv_id").alias("known"))

    own = parts.where(F.col("kind") == OWN)
    told = own.where("parent_conv_id is not null").select(*NODE)
    above = known.select("shard", "side", (F.col("depth") + 1).alias("depth"), "known")
    rest = own.where("parent_conv_id is null").join(above, ["shard", "side", "depth"]).withColumn("parent_conv_id", F.col("known")).select(*NODE)
    ends = parts.where(F.col("kind") == END).join(known, ["shard", "side", "depth"]).select(F.col("known").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    tops = top.where(F.col("kind") == OWN).drop("ends_sha256").join(digests(ends), ["conv_id", "depth"], "left")
    tops = tops.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))).select(*NODE)
    return told.unionByName(rest).unionByName(tops)
