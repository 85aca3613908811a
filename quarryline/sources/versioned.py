"""Tables in key buckets under one manifest a version, so that a load rewrites only the buckets that it touches.

    <path>/data/<write>/__bucket=<k>/*.parquet     written once, never changed
    <path>/manifests/<version>.json                key, buckets, schema, and each bucket's folders

A load writes new folders for its buckets and then one manifest, by a rename that fails if that version is there
already; readers take the newest manifest and never see half a load. A load that fails leaves
the version before, and one that another has overtaken is refused. Folders that no kept manifest names
go with `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import load
from ..operators.tables import keyed_diff
from .ingest import align


class Overtaken(RuntimeError):
    """Another load has written the version that this one wanted to."""


@dataclass(frozen=True)
class Manifest:
    """What one version consists of; folders are relative to the table."""

    version: int
    key: tuple[str, ...]
    buckets: int
    splits: int
    schema: StructType
    folders: dict[int, tuple[str, ...]]

    def text(self) -> str:
        return json.dumps({"version": self.version, "key": self.key, "buckets": self.buckets, "splits": self.splits, "schema": self.schema.jsonValue(), "folders": self.folders})

    @classmethod
    def of(cls, text: str) -> Manifest:
        m = json.loads(text)
        return cls(m["version"], tuple(m["key"]), m["buckets"], m["splits"], StructType.fromJson(m["schema"]), {int(b): tuple(f) for b, f in m["folders"].items()})


class VersionedTable:
    """A table at a path that Spark's readers and writers reach; its state is in its manifests alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, df: DataFrame, path: str, key: list[str], buckets: int = 64, splits: int = 1) -> VersionedTable:
        """The first version. buckets: how finely loads can rewrite; splits: how many tasks write a bucket."""
        if not key:
            raise ValueError("a versioned table needs a key")
        table = cls(df.sparkSession, path)
        if table.versions():
            raise ValueError(f"there is a table at {path}")
        empty = Manifest(0, tuple(key), buckets, splits, df.schema, {})
        table._commit(replace(empty, version=1, folders=table._write(empty, df)))
        return table

    # Versions.

    def versions(self) -> list[int]:
        home = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}")
        return Manifest.of("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{version or have[-1]:020d}.json").collect()))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.manifest(version))

    def diff(self, old: int, new: int, compare: list[str] | None = None) -> DataFrame:
        """(key.., change) created, updated or deleted between two versions; of both, only buckets with other folders are read."""
        a, b = self.manifest(old), self.manifest(new)
        other = {k for k in {*a.folders, *b.folders} if a.folders.get(k) != b.folders.get(k)}
        before, after = align(*[self._rows(replace(m, folders={k: f for k, f in m.folders.items() if k in other})) for m in (a, b)])
        return keyed_diff(before, after, list(b.key), compare or [c for c in after.columns if c not in b.key])

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest versions and the folders that only they had; returns how many folders went. Not beside a running load."""
        have = self.versions()
        named = {f.split("/")[1] for v in have[-keep:] for folders in self.manifest(v).folders.values() for f in folders}
        for v in have[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:020d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    # Loads. Each returns the version that it has written, or the present one if there was nothing to load.

    def upsert(self, batch: DataFrame, order: Column) -> int:
        """Rows replace those of their key or join them; the last of a batch by `order` wins; new columns are null in the rows before."""
        return self._load(batch, lambda old, new, key: load.upsert(old, new, key, order))

    def load_history(self, candidates: DataFrame, tracked: list[str], now: Column, order: Column | None = None, **names) -> int:
        """A history load (see load.scd2) on the buckets of the candidates' keys; columns by which they are ordered aren't kept."""
        return self._load(candidates, lambda old, new, key: load.scd2(old, new, key, tracked, now, order=order, **names), widen=False)

    def load_events(self, batch: DataFrame, now: Column) -> int:
        """Events that aren't there yet, once each."""
        return self._load(batch, lambda old, new, key: load.load_events(*align(old, new.withColumn("inserted_at", F.lit(None).cast("timestamp"))), now))

    def prune(self, candidates: DataFrame, failed: DataFrame | None = None) -> int:
        """Keep the keys of the candidates; nothing goes if any row failed. Buckets that lose no row keep their folders."""
        if failed is not None and not failed.isEmpty():
            return self.manifest().version
        base = self.manifest()
        key = list(base.key)
        lost = self._rows(base).alias("t").join(candidates.select(*key).distinct().alias("c"), load.same_key("t", "c", key), "left_anti")
        return self._load(lost.select(*key), lambda old, new, key: old.alias("t").join(new.distinct().alias("c"), load.same_key("t", "c", key), "left_anti"), base=base, widen=False)

    def replace(self, df: DataFrame) -> int:
        """All rows anew, unless df is empty; df may read this table."""
        base = self.manifest()
        folders = self._write(base, df)
        if not folders:
            return base.version
        return self._commit(replace(base, version=base.version + 1, schema=df.schema, folders=folders))

    def _load(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame, list[str]], DataFrame], base: Manifest | None = None, widen: bool = True) -> int:
        base = base or self.manifest()
        # Written first, so that the batch is worked out once and its buckets are known.
        staged = self._write(base, batch)
        if not staged:
            return base.version
        new = self.spark.read.schema(batch.schema).parquet(*[f"{self.path}/{f}" for folders in staged.values() for f in folders])
        old = self._rows(replace(base, folders={b: f for b, f in base.folders.items() if b in staged}))
        merged = merge(old, new, list(base.key))
        written = self._write(base, merged)
        kept = {b: f for b, f in base.folders.items() if b not in staged}
        version = self._commit(replace(base, version=base.version + 1, schema=merged.schema if widen else base.schema, folders=kept | written))
        self._fs.delete(self._path("/".join(next(iter(staged.values()))[0].split("/")[:2])), True)
        return version

    # Files.

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.path}/{below}" if below else self.path)

    def _rows(self, m: Manifest) -> DataFrame:
        paths = [f"{self.path}/{f}" for folders in m.folders.values() for f in folders]
        return self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)

    def _write(self, m: Manifest, df: DataFrame) -> dict[int, tuple[str, ...]]:
        """df in new folders, one a bucket that has rows."""
        keys = [F.col(k).cast("string") for k in m.key]
        name = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(m.buckets)))
        dealt.repartition("__bucket", F.pmod(F.xxhash64(F.lit("split"), *keys), F.lit(m.splits))).write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory()]
        return {int(n.removeprefix("__bucket=")): (f"{name}/{n}",) for n in found if n.startswith("__bucket=")}

    def _commit(self, m: Manifest) -> int:
        target, draft = self._path(f"manifests/{m.version:020d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(m.text().encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), never)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Overtaken(f"version {m.version} of {self.path} is there already") from error
            raise
        return m.version
