"""Keyed tables as snapshots: buckets of rows, a manifest for each version, commits that may fail.

A table is a folder of Parquet files by bucket, a range of its integer keys, and a folder
of manifests; manifest n lists the files of version n. Keys are given in the order of
arrival, and what changes is mostly what came last, so changes meet few buckets. A change rewrites the buckets that its keys
fall into and no others, writes its files beside the old ones and commits by renaming
its manifest to the next number. A rename onto a name that exists fails, so of two
writers that started from the same version one wins and the other gets `Conflict`; it
reads the new version and tries again. Readers take the files of one version, so they
never see half a change, and a writer that dies leaves files that no manifest names.

Rows are Spark's to read and write; what passes through the driver is one line of a
manifest for each bucket.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = "manifests/{:012d}.json"


class Conflict(Exception):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: its number, the files of each bucket, and what the table is."""

    number: int
    files: dict[int, list[str]]  # bucket: folders
    schema: str
    key: str
    size: int  # keys in a bucket
    most: int  # the largest key that the table has had
    rows: dict[int, int]


class Table:
    """A keyed table under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop
        self._fs = self._jvm.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str = "id", size: int = 100_000) -> Table:
        """A new table of some rows; `Conflict` if there is one."""
        table = cls(spark, path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        table._commit(Version(-1, {}, schema, key, size, 0, {}), rows, set(), adds=True)
        return table

    def _path(self, name: str):
        return self._jvm.fs.Path(f"{self.path}/{name}")

    def latest(self) -> Version:
        """The last version that was committed."""
        folder = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.at(max(numbers))

    def at(self, number: int) -> Version:
        """A version by its number."""
        lines = self.spark.read.text(str(self._path(_NAME.format(number)).toString()), wholetext=True).first()[0]
        found = json.loads(lines)
        return Version(number, {int(b): f for b, f in found["files"].items()}, found["schema"], found["key"], found["size"], found["most"], {int(b): n for b, n in found["rows"].items()})

    def read(self, version: Version | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version (the latest), or of some of its buckets."""
        version = version or self.latest()
        files = [f"{self.path}/{f}" for b, own in sorted(version.files.items()) if only is None or b in only for f in own]
        if not files:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*files)

    def change(self, keys: DataFrame, step: Callable[[DataFrame], DataFrame], tries: int = 5, wait: float = 0.2) -> Version:
        """Replace the rows of the buckets that `keys` (a column named as the key) fall into by `step` of them.

        `step` must leave rows in their buckets, that is keep their keys; it may add
        rows whose keys are among `keys`. After a conflict it is run again on the newer
        rows, `tries` times in all.
        """
        for attempt in range(tries):
            version = self.latest()
            touched = {r[0] for r in keys.select(self._bucket(version)).distinct().collect()}  # at most as many as there are buckets
            if not touched:
                return version
            try:
                return self._commit(version, step(self.read(version, touched)), touched)
            except Conflict:
                if attempt + 1 == tries:
                    raise
                time.sleep(wait * 2**attempt)
        raise AssertionError("unreachable")

    def add(self, rows: Callable[[Version], DataFrame], tries: int = 5) -> Version:
        """Append rows that `rows(version)` makes for a version (so that new keys follow its largest one); no bucket is read."""
        for attempt in range(tries):
            version = self.latest()
            try:
                return self._commit(version, rows(version), set(), adds=True)
            except Conflict:
                if attempt + 1 == tries:
                    raise
        raise AssertionError("unreachable")

    @staticmethod
    def _bucket(version: Version) -> Column:
        return F.floor(F.col(version.key) / version.size).cast("int").alias("bucket")

    def _commit(self, version: Version, rows: DataFrame, touched: set[int], adds: bool = False) -> Version:
        folder = f"data/{version.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        bucketed = rows.select("*", self._bucket(version))
        bucketed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = self._path(folder)
        schema = f"{version.schema}, bucket int"
        there = self.spark.read.schema(schema).parquet(str(written.toString()))
        made = there.groupBy("bucket").agg(F.count("*").alias("n"), F.max(version.key).alias("most")).collect()  # a row for each bucket
        files = dict(version.files) if adds else {b: f for b, f in version.files.items() if b not in touched}
        counts = {b: n for b, n in version.rows.items() if b in files}
        for r in made:
            if not adds and r.bucket not in touched:
                raise ValueError(f"a change of buckets {sorted(touched)} gave rows of bucket {r.bucket}")
            files[r.bucket] = [*files.get(r.bucket, []), f"{folder}/bucket={r.bucket}"]
            counts[r.bucket] = counts.get(r.bucket, 0) + r.n
        most = max([version.most, *(r.most for r in made if isinstance(r.most, int))])
        fresh = Version(version.number + 1, files, version.schema, version.key, version.size, most, counts)
        self._publish(fresh)
        return fresh

    def _publish(self, version: Version) -> None:
        """Write the manifest under a name of our own and rename it; the name of a version can be taken once."""
        body = json.dumps({"files": version.files, "schema": version.schema, "key": version.key, "size": version.size, "most": version.most, "rows": version.rows})
        self._fs.mkdirs(self._path("manifests"))
        own, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(_NAME.format(version.number))
        out = self._fs.create(own)
        out.write(bytearray(body.encode()))
        out.close()
        context = self._jvm.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.fs.Options, "Rename"), 0)
        try:
            context.rename(own, name, none)  # fails where the name exists
        except Exception as e:
            self._fs.delete(own, False)
            if "already exist" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version.number} of {self.path} is there already") from e
            raise

    def clean(self, keep: int = 2) -> None:
        """Delete folders that none of the last `keep` versions names, and older manifests."""
        last = self.latest().number
        kept = [self.at(n) for n in range(max(0, last - keep + 1), last + 1)]
        named = {f.split("/")[1] for v in kept for own in v.files.values() for f in own}
        for folder in self._fs.listStatus(self._path("data")):
            if folder.getPath().getName() not in named and int(folder.getPath().getName().split("-")[0]) <= last:
                self._fs.delete(folder.getPath(), True)
        for n in range(last - keep, -1, -1):
            if not self._fs.delete(self._path(_NAME.format(n)), False):
                break
