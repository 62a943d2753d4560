"""A keyed table on files that rewrites only what changes: hash buckets under numbered manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewing.plans import order as od

_BUCKET, _AGE = "_bucket", "_age"


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one read the store; read again and repeat."""


@dataclass(frozen=True)
class Manifest:
    """One version: the folder that holds each non-empty bucket, of `buckets` in all."""

    version: int
    buckets: int
    schema: str
    folders: dict[int, str]


class BucketStore:
    """Rows by a unique key, in `buckets` hash buckets; a bucket is one folder of Parquet files.

    A write puts new folders beside the old ones and then creates the next manifest, which names the
    folder of every bucket: new ones where something changed, the previous one's elsewhere. Readers see
    a version once its manifest is whole, and keep reading an older one meanwhile. Creating a manifest
    fails if its number is taken, so of two writers one has to repeat. Folders of writers that died and of
    old versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 256):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    # ---- reading

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest whole manifest, or that of a version; None if there is none."""
        for number in sorted(self._numbers(), reverse=True) if version is None else [version]:
            raw = self._text(self._manifest_path(number))
            # A manifest ends with a line that says so; one without it is still being written, or never will be.
            if raw is not None and raw.endswith("\nend\n"):
                found = json.loads(raw[:-5])
                return Manifest(number, found["buckets"], found["schema"], {int(b): f for b, f in found["folders"].items()})
        return None

    def read(self, version: int | None = None, keys: Iterable | None = None) -> DataFrame | None:
        """All rows, or those with one of a few keys, for which only their buckets are opened. None without a version."""
        manifest = self.manifest(version)
        if manifest is None:
            return None
        if keys is None:
            return self._rows(manifest, manifest.folders)
        keys = list(keys)
        wanted = self._buckets_of(keys, manifest)
        rows = self._rows(manifest, {b: f for b, f in manifest.folders.items() if b in wanted})
        return rows.where(F.col(self.key).isin(keys))

    def _rows(self, manifest: Manifest, folders: dict[int, str]) -> DataFrame:
        schema = T._parse_datatype_string(manifest.schema)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for _, f in sorted(folders.items())])

    def _buckets_of(self, keys: list, manifest: Manifest) -> set[int]:
        if not keys:
            return set()
        kind = T._parse_datatype_string(manifest.schema)[self.key].dataType
        rows = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        return {r[0] for r in rows.select(self._bucket(manifest.buckets)).distinct().collect()}

    # ---- writing

    def overwrite(self, rows: DataFrame) -> Manifest:
        """`rows` as the next version, whatever there was. Keys must be unique."""
        last = self.manifest()
        return self._commit(last, self.buckets, rows.schema, self._written(rows, self.buckets))

    def upsert(self, rows: DataFrame) -> Manifest:
        """Add rows and replace those whose key is there already, and nothing but their buckets.

        A key that `rows` has more than once keeps the least of its rows by all columns. Columns that
        either side lacks are null. Without a version this is the first.
        """
        last = self.manifest()
        if last is None:
            return self._commit(None, self.buckets, rows.schema, self._written(self._one_per_key(rows.withColumn(_AGE, F.lit(0))), self.buckets))
        # One row for each bucket at most reaches the driver.
        touched = {r[0] for r in rows.select(self._bucket(last.buckets)).distinct().collect()}
        old = self._rows(last, {b: f for b, f in last.folders.items() if b in touched})
        both = rows.withColumn(_AGE, F.lit(0)).unionByName(old.withColumn(_AGE, F.lit(1)), allowMissingColumns=True)
        fresh = self._one_per_key(both)
        folders = {b: f for b, f in last.folders.items() if b not in touched} | self._written(fresh, last.buckets)
        return self._commit(last, last.buckets, fresh.schema, folders)

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in rows.columns if c not in (self.key, _AGE)]
        return od.keep_first(rows.withColumn("_tie", F.xxhash64(*rest)), self.key, [_AGE, "_tie"]).drop(_AGE, "_tie")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int").alias(_BUCKET)

    def _written(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Write rows to new folders, a bucket in each, and name those that hold something."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self._bucket(buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{name}")
        found = (status.getPath().getName() for status in self._files().listStatus(self._path(f"{self.root}/{name}")))
        return {int(f.split("=")[1]): f"{name}/{f}" for f in found if f.startswith(f"{_BUCKET}=")}

    def _commit(self, last: Manifest | None, buckets: int, schema: T.StructType, folders: dict[int, str]) -> Manifest:
        taken = self._numbers()
        version = max(taken, default=-1) + 1
        now = self.manifest()
        if (now and now.version) != (last and last.version):
            raise ConcurrentWrite(f"version {now.version} was committed meanwhile")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        body = json.dumps({"buckets": buckets, "schema": fields, "folders": folders}) + "\nend\n"
        try:
            out = self._files().create(self._path(self._manifest_path(version)), False)
        except Exception as error:
            raise ConcurrentWrite(f"version {version} is taken") from error
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        return Manifest(version, buckets, fields, folders)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the newest `keep` whole versions names, and older manifests. Not while others write."""
        whole = [m for m in map(self.manifest, sorted(self._numbers(), reverse=True)) if m]
        named = {f.split("/")[1] for m in whole[:keep] for f in m.folders.values()}
        gone = []
        data = self._path(f"{self.root}/data")
        for status in self._files().listStatus(data) if self._files().exists(data) else []:
            if status.getPath().getName() not in named:
                self._files().delete(status.getPath(), True)
                gone.append(status.getPath().getName())
        for m in whole[keep:]:
            self._files().delete(self._path(self._manifest_path(m.version)), False)
        return gone

    # ---- files

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._files().exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files().listStatus(folder)]
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]

    def _text(self, name: str) -> str | None:
        path = self._path(name)
        if not self._files().exists(path):
            return None
        stream = self._files().open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def label_store(spark: SparkSession, root: str, buckets: int = 256) -> BucketStore:
    """The store of labels, by notice."""
    return BucketStore(spark, root, "notice_id", buckets)
