"""Sharding: size-tiered compaction of immutable shards under a versioned, atomically committed manifest."""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, base: int, fanout: int) -> int:
    """0 up to `base` bytes; one more for each power of `fanout` above."""
    return max(0, math.ceil(math.log(max(size, 1) / base, fanout) - 1e-9))


def plan_merges(shards: list[dict], target: int, base: int, fanout: int) -> list[list[dict]]:
    """Groups to merge: runs of shards of one tier in order of arrival, as many as fit into `target` bytes.

    A group has at least `fanout` shards, or half of `target`. Shards of half the target or more are left alone.
    """
    tiers: dict[int, list[dict]] = {}
    for s in sorted(shards, key=lambda s: s["seq"]):
        if s["bytes"] * 2 < target:
            tiers.setdefault(tier(s["bytes"], base, fanout), []).append(s)
    groups = []
    for _, run in sorted(tiers.items()):
        group, size = [], 0
        for s in [*run, None]:
            if s is None or size + s["bytes"] > target:
                if len(group) >= 2 and (len(group) >= fanout or size * 2 >= target):
                    groups.append(group)
                group, size = [], 0
            if s is not None:
                group.append(s)
                size += s["bytes"]
    return groups


class ShardStore:
    """A folder of immutable Parquet shards. The manifest of the highest version names those that count.

    A commit writes the new manifest under a name of its own and renames it to its version; the rename fails if that
    version exists, so of two writers one wins and the other has to start from the new state. Files that no
    manifest names are invisible; whatever a lost executor leaves behind is harmless.
    """

    def __init__(self, spark: SparkSession, folder: str, target: int = 128 << 20, base: int = 4 << 20, fanout: int = 4):
        self.spark, self.folder, self.target, self.base, self.fanout = spark, folder.rstrip("/"), target, base, fanout
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        f, path = fs.FileSystem.from_uri(f"{self.folder}/manifest/v{version:08d}.json")
        with f.open_input_stream(path) as s:
            return json.loads(s.read())

    def commit(self, base: dict, shards: list[dict], schema: str) -> int:
        """Make base's successor with these shards."""
        version = base["version"] + 1
        f, path = fs.FileSystem.from_uri(f"{self.folder}/manifest")
        part = f"part-{uuid.uuid4().hex}"
        with f.open_output_stream(f"{path}/{part}") as s:
            s.write(json.dumps({"version": version, "schema": schema, "shards": shards}).encode())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(f"{self.folder}/manifest/{part}"), self._path(f"{self.folder}/manifest/v{version:08d}.json"), none)
        except Exception as e:
            self._fs.delete(self._path(f"{self.folder}/manifest/{part}"), False)
            if self.version() >= version:
                raise CommitConflict(f"version {version} is taken") from e
            raise
        return version

    def _listed(self, folder: str, first: int) -> list[dict]:
        """Shards just written to a folder, with their rows."""
        sizes = sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet"))
        if not sizes:
            return []
        counted = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()
        rows = {r.f: r.n for r in counted}
        relative = folder[len(self.folder) + 1 :]
        kept = [(n, b) for n, b in sizes if rows.get(n)]
        return [{"path": f"{relative}/{n}", "bytes": b, "rows": rows[n], "seq": first + k} for k, (n, b) in enumerate(kept)]

    def append(self, df: DataFrame, shard_rows: int = 8192) -> int:
        """Add the rows of df as shards of at most `shard_rows`, each a file of one task; the new version."""
        folder, schema = f"{self.folder}/shards/{uuid.uuid4().hex}", df.schema.json()
        listed = None
        while True:  # a writer that was faster has changed the manifest, not the files: the append starts from there
            now = self.manifest()
            if now["schema"] not in (None, schema):
                self._fs.delete(self._path(folder), True)
                raise ValueError("the store has another schema")
            if listed is None:
                df.write.option("maxRecordsPerFile", shard_rows).parquet(folder)
                listed = self._listed(folder, 0)
            first = 1 + max((s["seq"] for s in now["shards"]), default=-1)
            try:
                return self.commit(now, now["shards"] + [s | {"seq": first + s["seq"]} for s in listed], schema)
            except CommitConflict:
                continue

    def compact(self) -> int:
        """Merge similarly sized shards until nothing is left to merge; the last version.

        A merge is one task that streams its shards into one file, with no shuffle. Each round is one commit. Replaced files
        stay, for readers of older versions, until vacuum().
        """
        while True:
            now = self.manifest()
            groups = plan_merges(now["shards"], self.target, self.base, self.fanout)
            if not groups:
                return now["version"]
            out = f"shards/{uuid.uuid4().hex}"
            jobs = [(k, [s["path"] for s in g]) for k, g in enumerate(groups)]
            rows = self.spark.createDataFrame(jobs, "id int, paths array<string>").repartitionByRange(len(jobs), "id")
            merged = {r.id: r for r in rows.mapInArrow(_merge(self.folder, out), "id int, path string, bytes long, rows long").collect()}
            gone = {s["path"] for g in groups for s in g}
            shards = [s for s in now["shards"] if s["path"] not in gone]
            for k, g in enumerate(groups):
                if merged[k].rows != sum(s["rows"] for s in g):
                    raise RuntimeError(f"merge {k} has lost rows")
                shards.append({"path": merged[k].path, "bytes": merged[k].bytes, "rows": merged[k].rows, "seq": g[0]["seq"]})
            try:
                self.commit(now, sorted(shards, key=lambda s: s["seq"]), now["schema"])
            except CommitConflict:  # plan anew; what was merged in vain is no one's
                self._fs.delete(self._path(f"{self.folder}/{out}"), True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests of all but the last `keep` versions, and the shards that only they name; how many shards.

        Readers of those versions must have ended. Shards that no manifest names, be it of an append under way, stay.
        """
        versions = range(1, self.version() + 1)
        known = {v: self.manifest(v) for v in versions if self._fs.exists(self._path(f"{self.folder}/manifest/v{v:08d}.json"))}
        old = sorted(known)[: max(0, len(known) - max(1, keep))]
        held = {s["path"] for v, m in known.items() if v not in old for s in m["shards"]}
        gone = {s["path"] for v in old for s in known[v]["shards"]} - held
        for p in sorted(gone):
            self._fs.delete(self._path(f"{self.folder}/{p}"), False)
        for v in old:
            self._fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}.json"), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if m["schema"] is None:
            raise PySparkException("the store is empty")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s['path']}" for s in m["shards"]))


def _merge(folder: str, out: str):
    def run(it):
        f, base = fs.FileSystem.from_uri(folder)
        for batch in it:
            for k, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{out}/merged-{k:06d}.parquet"
                part = f"{base}/{out}/_{uuid.uuid4().hex}"
                f.create_dir(f"{base}/{out}", recursive=True)
                rows, writer, held, size = 0, None, [], 0
                with f.open_output_stream(part) as sink:
                    for p in paths:
                        with f.open_input_file(f"{base}/{p}") as source:
                            for b in pq.ParquetFile(source).iter_batches(2048):
                                if writer is None:
                                    schema = b.schema
                                    writer = pq.ParquetWriter(sink, schema, compression="snappy")
                                held.append(b)
                                rows += b.num_rows
                                size += b.nbytes
                                if size >= 32 << 20:
                                    writer.write_table(pa.Table.from_batches(held, schema))
                                    held, size = [], 0
                    if held:
                        writer.write_table(pa.Table.from_batches(held, schema))
                    writer.close()
                f.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array([k], pa.int32()), "path": [name], "bytes": pa.array([f.get_file_info(f"{base}/{name}").size], pa.int64()), "rows": pa.array([rows], pa.int64())})

    return run


def shard_documents(docs: DataFrame, folder: str, shard_rows: int = 8192, **sizes) -> DataFrame:
    """Append docs to a store in `folder` (a URI), compact it and read it back by its manifest.

    Same rows and columns as docs, in any types Parquet has, nulls, repeats and long texts included; an empty table
    gives an empty one. A file larger than the target size stays as it is.
    """
    store = ShardStore(docs.sparkSession, folder, **sizes)
    store.append(docs, shard_rows)
    store.compact()
    return store.read()
