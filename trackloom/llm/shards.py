"""Training shards with size-tiered compaction and a versioned manifest.

A store is a folder of immutable Parquet shards and of manifests. Arrivals are
appended as they come, as small shards. ``compact`` merges runs of similarly
sized shards: shards of one tier (sizes within a factor of ``FAN``), in order of
arrival, are gathered until they fill a target-sized file or, if they don't,
until there are ``FAN`` of them, and become one shard of a higher tier. A row is
rewritten at most once a tier.

A commit writes the manifest of the next version beside its final name and
renames it there, which fails if another writer got that version first; then the
writer reads the newest manifest and tries anew. Readers see only what a manifest
lists: files of tasks or jobs that failed are never listed, so losing an executor
or the driver midway loses nothing. Superseded shards are deleted by ``vacuum``.

Each merge is a scan of one run that one task writes, so text doesn't move
between executors; merges run beside each other. Rows, nulls and extra columns are kept as they are, repeated rows too.
An empty arrival adds no shard; a store without arrivals is empty.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
FAN = 4
#: Merges that run beside each other.
AT_ONCE = 16


@dataclass(frozen=True)
class Shard:
    """One file: its path under the store, size in bytes, rows, order of arrival and tier."""

    path: str
    size: int
    rows: int
    order: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    shards: tuple[Shard, ...]
    next_order: int = 0


class Conflict(Exception):
    """Another writer committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest(0, None, ())
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["version"], raw["schema"], tuple(Shard(**s) for s in raw["shards"]), raw["next_order"])

    def commit(self, new: Manifest) -> None:
        """Make ``new`` the manifest of its version, or raise Conflict if there is one."""
        draft = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema, "next_order": new.next_order, "shards": [asdict(s) for s in new.shards]}).encode()))
        finally:
            out.close()
        final = self._path(self._name(new.version))
        try:
            if self._fs.exists(final):
                raise Conflict(new.version)
            self._files.rename(draft, final, self._no_overwrite)
        except Exception as e:
            self._fs.delete(draft, False)
            if isinstance(e, Conflict) or "FileAlreadyExists" in str(e):
                raise Conflict(new.version) from None
            raise

    def _change(self, edit) -> Manifest:
        """Commit ``edit`` of the newest manifest, again if another writer comes first."""
        while True:
            now = self.manifest()
            new = edit(now)
            if new is now:
                return now
            try:
                self.commit(new)
                return new
            except Conflict:
                continue

    # files

    def _written(self, folders: list[str]) -> dict[str, list[tuple[str, int, int]]]:
        """By finished folder its files in order of their names: path under the store, bytes, rows. Rows come from file footers."""
        sizes = {f"{d}/{s.getPath().getName()}": s.getLen() for d in folders for s in self._fs.listStatus(self._path(f"{self.root}/{d}")) if s.getPath().getName().endswith(".parquet")}
        out: dict[str, list[tuple[str, int, int]]] = {d: [] for d in folders}
        if sizes:
            last = F.substring_index(F.col("_metadata.file_path"), "/", -3)
            for r in self.spark.read.parquet(*[f"{self.root}/{d}" for d in folders]).groupBy(last.alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect():
                out[r.path.rpartition("/")[0]].append((r.path, sizes[r.path], r.n))
        return out

    def _write(self, df: DataFrame) -> str:
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def append(self, arrivals: DataFrame) -> Manifest:
        """Add rows as small shards, a file for each partition of ``arrivals``, and commit them."""
        schema = arrivals.schema.json()
        folder = self._write(arrivals)
        files = self._written([folder])[folder]

        def edit(now: Manifest) -> Manifest:
            if now.schema is not None and T.StructType.fromJson(json.loads(now.schema)).names != arrivals.columns:
                raise ValueError("arrivals have other columns than the store")
            new = tuple(Shard(p, size, rows, now.next_order + k, 0) for k, (p, size, rows) in enumerate(files))
            return Manifest(now.version + 1, now.schema or schema, now.shards + new, now.next_order + len(new))

        return self._change(edit)

    def plan(self, now: Manifest) -> list[list[Shard]]:
        """Runs of shards to merge next."""
        runs = []
        by_tier: dict[int, list[Shard]] = {}
        for s in sorted(now.shards, key=lambda s: s.order):
            if s.size < self.target / 2:
                by_tier.setdefault(self.size_class(s.size), []).append(s)
        for own in by_tier.values():
            run: list[Shard] = []
            for s in own:
                if run and sum(x.size for x in run) + s.size > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fan or sum(x.size for x in run) >= self.target / 2:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def size_class(self, size: int) -> int:
        """0 for the smallest shards, one more for each factor of ``fan``."""
        t = 0
        while size >= self.target / self.fan ** (8 - t) and t < 8:
            t += 1
        return t

    def compact(self) -> Manifest:
        """Merge until no tier has a run to merge; every round is committed by itself."""
        now = self.manifest()
        while runs := self.plan(now):
            schema = T.StructType.fromJson(json.loads(now.schema))
            read = self.spark.read.schema(schema).parquet
            with ThreadPoolExecutor(AT_ONCE) as pool:
                folders = list(pool.map(lambda r: self._write(read(*[f"{self.root}/{s.path}" for s in r]).coalesce(1)), runs))
            files = self._written(folders)
            made: dict[str, Shard] = {}
            for r, folder in zip(runs, folders, strict=True):
                if sum(f[2] for f in files[folder]) != sum(s.rows for s in r):
                    raise RuntimeError("a merge lost or gained rows; nothing was committed")
                for k, (path, size, rows) in enumerate(files[folder]):
                    made[path] = Shard(path, size, rows, r[min(k, len(r) - 1)].order, max(s.tier for s in r) + 1)
            gone = {s.path for r in runs for s in r}

            def edit(newest: Manifest, made=made, gone=gone) -> Manifest:
                if not gone <= {s.path for s in newest.shards}:
                    raise RuntimeError("another writer merged the same shards; nothing was committed")
                kept = tuple(s for s in newest.shards if s.path not in gone)
                return replace(newest, version=newest.version + 1, shards=tuple(sorted((*kept, *made.values()), key=lambda s: s.order)))

            now = self._change(edit)
        return now

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete files that none of the newest ``keep_versions`` manifests lists; those of unfinished writers too, so call it when there are none."""
        kept = self.versions()[-keep_versions:]
        listed = {s.path for v in kept for s in self.manifest(v).shards}
        gone = 0
        top = self._path(f"{self.root}/shards")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else ():
            names = [f"shards/{folder.getPath().getName()}/{f.getPath().getName()}" for f in self._fs.listStatus(folder.getPath())]
            if not listed & set(names):
                gone += bool(self._fs.delete(folder.getPath(), True))
                continue
            for n in names:
                if n not in listed and n.endswith(".parquet"):
                    gone += bool(self._fs.delete(self._path(f"{self.root}/{n}"), False))
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._path(self._name(v)), False)
        return gone

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the path of the shard they are in as ``_shard``."""
        now = self.manifest(version)
        if now.schema is None:
            return self.spark.createDataFrame([], "_shard string")
        schema = T.StructType.fromJson(json.loads(now.schema))
        if not now.shards:
            return self.spark.createDataFrame([], schema).withColumn("_shard", F.lit(""))
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in now.shards])
        return df.withColumn("_shard", F.concat(F.lit("shards/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.lit("/"), F.col("_metadata.file_name")))
