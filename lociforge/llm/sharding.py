"""Size-tiered sharding: arrivals become small immutable shards, shards of similar size merge, a manifest names what counts.

A store is a folder with ``data/`` (Parquet files, never changed) and ``manifest/`` (one JSON-lines file per version, a
line for each shard). A version is written aside and renamed into place without replacing: of two writers that want one
number the file system lets one through, so readers see a whole version or none. That needs a file system whose rename is
atomic; on plain object stores one writer at a time is safe. Merges read a tier's shards and write one file for each
group, without a shuffle. Merged shards stay until ``vacuum``, so a reader of any version that is retained goes on while
merges run. DataFrame operations only; files are listed through the store's own file system.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

TARGET_BYTES = 64 << 20
FAN_IN = 4
#: Versions that ``vacuum`` leaves.
RETAIN = 2
#: Groups that one job merges.
JOB_GROUPS = 256
#: Manifest rows up to which a manifest is broadcast.
BROADCAST_SHARDS = 100_000
SHARD = "path string, bytes long, rows long, tier int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- manifest

    def version(self) -> int:
        """The last committed version, 0 for a new store."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest")))
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def shards(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return [json.loads(x) for x in bytes(stream.readAllBytes()).decode().splitlines()]
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict]) -> int:
        """Publishes ``shards`` as the version after ``base``; FileExistsError if another commit came first."""
        jvm = self.spark._jvm
        aside, target = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(self._file(base + 1))
        out = self._fs.create(aside, False)
        out.write("".join(json.dumps(s) + "\n" for s in shards).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, target, options)  # without OVERWRITE
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise FileExistsError(self._file(base + 1)) from e
            raise
        return base + 1

    def _publish(self, base: int, kept: list[dict], new: list[dict]) -> int:
        """``commit``; if it fails, the new shards go, as no version names them."""
        try:
            return self.commit(base, kept + new)
        except BaseException:
            for folder in {s["path"].rpartition("/")[0] for s in new}:
                self._fs.delete(self._path(folder), True)
            raise

    def vacuum(self, retain: int = RETAIN) -> int:
        """Deletes versions but the last ``retain``, and shards that only those named; returns how many shards went."""
        last = self.version()
        old = [v for v in range(1, last - max(retain, 1) + 1) if self._fs.exists(self._path(self._file(v)))]
        used = {s["path"] for v in range(max(1, last - max(retain, 1) + 1), last + 1) for s in self.shards(v)}
        gone = {s["path"] for v in old for s in self.shards(v)} - used
        for path in gone:
            self._fs.delete(self._path(path), False)
        for v in old:
            self._fs.delete(self._path(self._file(v)), False)
        return len(gone)

    # -- data

    def tier(self, size: int) -> int:
        """Powers of the fan-in below the target: 0 for shards that are ready, 1 for those within one fan-in of it, and so on."""
        return max(0, math.ceil(math.log(max(1.0, 0.75 * self.target / max(size, 1)), self.fan_in) - 1e-9))

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        rows = {r[0]: r[1] for r in self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name")).count().collect()}
        return [{"path": f"{folder}/{n}", "bytes": b, "rows": rows[n], "tier": self.tier(b)} for n, b in sorted(sizes.items()) if n in rows]

    def append(self, df: DataFrame) -> int:
        """One arrival: each scan task's rows become a shard. Empty shards are left out."""
        base = self.version()
        return self._publish(base, self.shards(base), self._write(df))

    def _groups(self, shards: list[dict], final: bool) -> list[list[dict]]:
        """Shards of a tier, in order, cut where a group would pass the target; a tier merges when it has fan-in many, or at last two."""
        out = []
        for t in sorted({s["tier"] for s in shards if s["tier"]}):
            alike, group, size = sorted((s for s in shards if s["tier"] == t), key=lambda s: s["path"]), [], 0
            if len(alike) < self.fan_in and not final:
                continue
            for s in alike:
                if group and size + s["bytes"] > 1.25 * self.target:
                    out.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self, final: bool = False) -> int:
        """Merges until no tier is due; ``final`` also merges what is below the fan-in, across tiers. Returns the version.

        What was merged stays readable through the versions before, until ``vacuum``.
        """
        while True:
            base = self.version()
            shards = self.shards(base)
            groups = self._groups(shards, final)
            if not groups and final:  # leftovers of different tiers
                groups = self._groups([s | {"tier": 1} for s in shards if s["tier"]], True)
            if not groups:
                return base
            groups = groups[:JOB_GROUPS]
            old = {s["path"] for g in groups for s in g}
            schema = self.spark.read.parquet(groups[0][0]["path"]).schema
            merged: DataFrame | None = None
            for g in groups:
                one = self.spark.read.schema(schema).parquet(*[s["path"] for s in g]).coalesce(1)
                merged = one if merged is None else merged.unionByName(one)
            new = self._write(merged)
            if sum(s["rows"] for s in new) != sum(s["rows"] for g in groups for s in g):
                raise RuntimeError("a merge lost or added rows; nothing is committed")
            self._publish(base, [s for s in shards if s["path"] not in old], new)

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, with ``_metadata`` of their shard."""
        paths = [s["path"] for s in self.shards(version)]
        if not paths:
            raise ValueError("the store is empty")
        return self.spark.read.parquet(*paths)

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(SHARD).json(self._file(self.version() if version is None else version))


def shard_documents(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Each document's shard after its table came in ``arrivals`` batches: ``doc_id, shard, shard_rows, shard_bytes, tier, version``.

    Rows are dealt to the arrivals by a hash of doc_id and text, however few files the table has; rows that repeat both
    come together. All rows and columns are kept as they are, nulls, repeated rows and long texts included; an empty
    table gives an empty result. tier is 0 for shards of target size. After each arrival the store is compacted, and
    vacuumed down to ``RETAIN`` versions.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes, fan_in)
    arrival = F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(arrival == k))
        store.compact()
        store.vacuum()
    version = store.compact(final=True)
    store.vacuum()
    none = spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("shard"), *(F.lit(0).cast("long").alias(c) for c in ("shard_rows", "shard_bytes")), F.lit(0).alias("tier"), F.lit(version).cast("long").alias("version"))
    if not store.shards(version):
        return none
    shards = store.manifest(version).select(F.element_at(F.split("path", "/"), -2).alias("_run"), F.element_at(F.split("path", "/"), -1).alias("_file"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier")
    path = F.split(F.col("_metadata.file_path"), "/")
    rows = store.read(version).select("doc_id", F.element_at(path, -2).alias("_run"), F.element_at(path, -1).alias("_file"))
    if len(store.shards(version)) <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    return rows.join(shards, ["_run", "_file"]).select("doc_id", F.concat_ws("/", "_run", "_file").alias("shard"), "shard_rows", "shard_bytes", "tier", F.lit(version).cast("long").alias("version"))
