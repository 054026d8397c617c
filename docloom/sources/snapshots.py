"""Tables that change together: versioned snapshots under one manifest, which is put in place once or not at all.

A table is cut into buckets by a hash of its key.  A change writes new files for the buckets that it touches and leaves the
others; a commit is a manifest of the next number that lists every bucket's files.  The manifest is written beside its place and
renamed to it, which fails where another writer has been first (as HDFS and local file systems do; a store without such a
rename needs one of its own).  So readers see all tables of one version, and a writer that loses or dies leaves files that no
manifest names.

Edge cases: a null key is a key like others, in a bucket of its own; a change of no rows touches nothing; repeated keys in a
table's rows stay, and a change of a key replaces all of them; a table without rows is empty, not absent.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Lost(RuntimeError):
    """Another writer has committed since."""


class Snapshots:
    """``tables``: for each name its key and schema.  All live below ``path``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.keys = {name: key for name, (key, _) in tables.items()}
        self.schemas = {name: T.StructType.fromDDL(schema) for name, (_, schema) in tables.items()}
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = hadoop.Path(f"{self.path}/manifests")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = hadoop.Path

    # ---- manifests

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        if not self._fs.exists(self._folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, dict[str, list[str]]]:
        if not version:
            return {name: {} for name in self.keys}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:020d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, base: int, changes: dict[str, dict[str, list[str]]]) -> int:
        """Put ``changes`` (of ``replaced`` or ``added``) on version ``base``; Lost if that is not the last one any more."""
        found = self._manifest(base)
        for name, parts in changes.items():
            found[name] = {**found[name], **parts}
        aside = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(json.dumps(found).encode())
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, self._path(f"{self.path}/manifests/{base + 1:020d}"), nothing)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Lost(f"version {base + 1} is there already") from None
            raise
        return base + 1

    # ---- rows

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets only if they are given."""
        parts = self._manifest(self.version() if version is None else version)[name]
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [p for b, ps in parts.items() if wanted is None or b in wanted for p in ps]
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def bucket(self, name: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.keys[name]).cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of some keys; a row for each bucket at most."""
        return sorted(r.b for r in keys.select(self.bucket(name).alias("b")).distinct().collect())

    def rows(self, name: str, keys: DataFrame, version: int) -> DataFrame:
        """A table's rows of some keys (a column named as its key), read from their buckets alone."""
        key = self.keys[name]
        own = keys.select(F.col(key).alias("__k")).distinct()
        return self.read(name, version, self.touched(name, keys)).join(own, F.col(key).eqNullSafe(F.col("__k")), "left_semi")

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        folder = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        names = self.schemas[name].names
        rows.select(*names, self.bucket(name).alias("__bucket")).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        written = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in written}

    def replaced(self, name: str, keys: DataFrame, new: DataFrame, version: int) -> dict[str, list[str]]:
        """Files in which all rows of ``keys`` give way to ``new``; buckets of other keys stay as they are."""
        key, touched = self.keys[name], self.touched(name, keys.select(self.keys[name]).unionByName(new.select(self.keys[name])))
        if not touched:
            return {}
        gone = keys.select(F.col(key).alias("__k")).distinct()
        stay = self.read(name, version, touched).join(gone, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
        written = self._write(name, stay.unionByName(new.select(*self.schemas[name].names)))
        return {str(b): written.get(str(b), []) for b in touched}

    def added(self, name: str, new: DataFrame, version: int) -> dict[str, list[str]]:
        """Files of ``new`` beside those that are there."""
        was = self._manifest(version)[name]
        return {b: was.get(b, []) + paths for b, paths in self._write(name, new).items()}
