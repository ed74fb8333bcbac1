"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, named

MANIFEST = "run string, tier int, bytes long, rows long, files int, since int, columns string"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class ShardStore:
    """A table kept as runs of immutable Parquet shards below ``root``, any folder that Spark reaches.

    ``append`` writes arrivals as a run of small shards. ``compact`` merges runs of one size tier, a power of
    ``fanout``, as soon as ``fanout`` of them are there, into files of about ``target_bytes``. A run has a name that
    nobody else uses and is never written to again. Each commit writes the manifest of one version, a single file,
    under a name of its own and then renames it to the version's, which fails if that is taken: a reader sees one
    version or the next, a commit that dies leaves nothing that a reader finds, and of two commits of one version the
    second fails, loses nothing of the first and can be tried again. The rename is as atomic as that of the file
    system. Versions stay readable until ``vacuum`` removes them. The driver handles a row for each run; there are a
    few for each tier, and tiers grow with the logarithm of the table.

    Rows are kept as they are: nulls, empty and very long texts, repeated rows. Runs may differ in their columns: the
    table has those of all its runs, and a run gives null where it lacks one; a column that changes its type is
    refused. Columns of any names can be stored. An empty arrival is a run of no rows.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.least = target_bytes, fanout, least_bytes

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least, self.fanout)) + 1) if size > self.least else 0

    def _version_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def versions(self) -> list[int]:
        """The committed versions, rising."""
        fs, p = _path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> list[dict]:
        """The runs of a version, the latest if none is named; no version: no runs."""
        if version is None:
            version = (self.versions() or [None])[-1]
        if version is None:
            return []
        rows = self.spark.read.schema(MANIFEST).json(self._version_path(version)).collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["run"])

    def _commit(self, runs: list[dict], base: int) -> int:
        """Version ``base`` + 1; fails if another writer has committed it."""
        self._columns(runs)
        fs, there = _path(self.spark, self._version_path(base + 1))
        _, here = _path(self.spark, f"{self.root}/manifest/staged-{uuid.uuid4().hex}")
        out = fs.create(here, False)
        try:
            out.write("".join(json.dumps(r) + "\n" for r in runs).encode())
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(there).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(here), fs.makeQualified(there), never_over)
        except Exception as e:
            fs.delete(here, False)
            if not fs.exists(there):
                raise
            raise RuntimeError(f"version {base + 1} was committed by another writer") from e
        return base + 1

    @staticmethod
    def _columns(runs: list[dict]) -> T.StructType:
        """The columns of all runs, in the order in which they came."""
        found: dict[str, T.StructField] = {}
        for r in sorted(runs, key=lambda r: r["since"]):
            for f in T.StructType.fromJson(json.loads(r["columns"])).fields:
                known = found.setdefault(f.name.lower(), T.StructField(f.name, f.dataType))
                if known.dataType != f.dataType:
                    raise TypeError(f"column {f.name} is {known.dataType.simpleString()} in earlier runs, not {f.dataType.simpleString()}")
        return T.StructType(list(found.values()))

    def _run(self, name: str, since: int, schema: T.StructType) -> dict:
        """A run's manifest row, from its files' sizes and the row counts in their footers."""
        fs, p = _path(self.spark, f"{self.root}/runs/{name}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")] if fs.exists(p) else []
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/runs/{name}").count() if sizes else 0
        return {"run": name, "tier": self.tier(sum(sizes)), "bytes": sum(sizes), "rows": rows, "files": len(sizes), "since": since, "columns": schema.json()}

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as a run of small shards, one for each task, and commit; the new version."""
        name = uuid.uuid4().hex
        arrivals.write.parquet(f"{self.root}/runs/{name}")
        return self.commit_run(name, arrivals.schema)

    def commit_run(self, name: str, schema: T.StructType) -> int:
        """Commit a run that is written below ``runs``; the new version."""
        base = (self.versions() or [0])[-1]
        return self._commit([*(self.manifest(base) if base else []), self._run(name, base + 1, schema)], base)

    def compact(self) -> int:
        """Merge tiers with ``fanout`` runs or more, smallest first, until none is left; the latest version."""
        while True:
            base = (self.versions() or [0])[-1]
            runs = self.manifest(base) if base else []
            full = [t for t in sorted({r["tier"] for r in runs}) if sum(r["tier"] == t for r in runs) >= self.fanout]
            if not full:
                return base
            merge = [r for r in runs if r["tier"] == full[0]]
            n = max(1, -(-sum(r["bytes"] for r in merge) // self.target))
            name, table = uuid.uuid4().hex, self._table(merge)
            # Whole input splits are put together, nothing is shuffled.
            table.coalesce(n).write.parquet(f"{self.root}/runs/{name}")
            made = self._run(name, base + 1, table.schema)
            if made["rows"] != sum(r["rows"] for r in merge):
                raise RuntimeError("a merge lost or repeated rows")
            made["tier"] = max(made["tier"], full[0] + 1)  # a merged run never meets its own sources' tier again
            made["since"] = min(r["since"] for r in merge)
            self._commit([r for r in runs if r not in merge] + [made], base)

    def _table(self, runs: list[dict]) -> DataFrame:
        schema = self._columns(runs)
        paths = [f"{self.root}/runs/{r['run']}" for r in runs if r["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame | None:
        """The table as of a version, and in the column ``shard``, if it is named, each row's run and file; None if nothing was ever appended."""
        runs = self.manifest(version)
        if not runs:
            return None
        df = self._table(runs)
        if shard is None:
            return df
        if shard.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"the table has a column {shard}")
        if not any(r["files"] for r in runs):
            return df.withColumn(shard, F.lit(None).cast("string"))
        return df.withColumn(shard, F.regexp_extract(F.col("_metadata.file_path"), r"runs/(.*)$", 1))

    def vacuum(self, older_than: float = 7 * 86400.0) -> list[str]:
        """Remove what no one needs that is older than ``older_than`` seconds; the names of the removed runs.

        These are versions before the latest, and runs and staged manifests that no remaining version names: readers
        of an old version and writers that have not committed yet must be done within that time.
        """
        least = (time.time() - older_than) * 1000
        found, (fs, root) = self.versions(), _path(self.spark, f"{self.root}/manifest")
        if not found:
            return []
        for s in fs.listStatus(root):
            if s.getModificationTime() <= least and s.getPath().getName() != f"v{found[-1]:08d}":
                fs.delete(s.getPath(), False)
        keep = {r["run"] for v in self.versions() for r in self.manifest(v)}
        gone = []
        for s in fs.listStatus(_path(self.spark, f"{self.root}/runs")[1]):
            # The arrivals of one write are runs in one folder; it goes with the last of them.
            shared = [(f"{s.getPath().getName()}/{c.getPath().getName()}", c) for c in fs.listStatus(s.getPath()) if c.isDirectory() and "=" in c.getPath().getName()]
            named = any(name in keep for name, _ in shared)
            runs = shared if named else [(s.getPath().getName(), s)]
            gone += [(name, c.getPath()) for name, c in runs if name not in keep and c.getModificationTime() <= least]
        for _, path in gone:
            fs.delete(path, True)
        return sorted(name for name, _ in gone)


def ingest(store: ShardStore, table: DataFrame, arrivals: int = 6, key: str = "doc_id") -> DataFrame:
    """Bring a table into ``store`` in ``arrivals`` appends by hash of the key, compacting after each; the stored table.

    The table is read once: one write deals it over the arrivals' runs, which are then committed in turn. Rows are
    whole, a null key is hashed like any other, repeated rows stay, and columns of any names are kept. An empty table
    gives empty runs and no rows.
    """
    by = fresh("arrival", table.columns)
    bucket = F.pmod(F.crc32(F.coalesce(named(key).cast("string"), F.lit(""))), F.lit(arrivals))
    name = uuid.uuid4().hex
    table.withColumn(by, bucket).write.partitionBy(by).parquet(f"{store.root}/runs/{name}")
    for k in range(arrivals):
        store.commit_run(f"{name}/{by}={k}", table.schema)
        store.compact()
    return store.read()
