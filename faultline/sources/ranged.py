"""Keyed tables in ranges of keys: an update rewrites the ranges its rows fall into, readers see whole versions.

A version is a manifest: for each file its key range, least and greatest key and number of rows. Files are written once and
never changed; a commit writes a new manifest and then creates the version after the one it was based on. Creating a
version that exists fails, so of two writers with the same base one wins, and the other is told. What a broken-off writer left
behind belongs to no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.maintain import latest_per_key
from faultline.sources.shared import checkpointed

#: Keys of one range.
RANGE_KEYS = 1 << 20
_MANIFEST = "file string, key_range long, first_key long, last_key long, rows long"


class StaleBase(Exception):
    """Another writer has committed since the version this update was based on."""


class RangedTable:
    """A table of rows with a unique whole-number key, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, range_keys: int = RANGE_KEYS):
        self.spark, self.folder, self.key, self.schema, self.range_keys = spark, folder, key, schema, range_keys

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest complete version; 0 before the first commit."""
        files, versions = self._files(), self._path("versions")
        if not files.exists(versions):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(versions) if s.getLen() > 0), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a version (the newest): file, key_range, first_key, last_key, rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        named = self.spark.read.text(f"{self.folder}/versions/{version}").first()[0]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/{named}")

    def _rows_of(self, manifest: DataFrame) -> DataFrame:
        paths = [r.file for r in manifest.select("file").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A reader keeps its version whatever is committed meanwhile."""
        return self._rows_of(self.manifest(version))

    def _range(self) -> Column:
        return F.floor(F.col(self.key) / self.range_keys)

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows to new files, one or more a range, and describe them."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        ranged = rows.select(*self.schema.names).withColumn("key_range", self._range())
        spread = ranged.repartition("key_range").sortWithinPartitions("key_range", self.key)
        spread.write.partitionBy("key_range").parquet(folder)
        written = self.spark.read.schema(T.StructType([*self.schema, T.StructField("key_range", T.LongType())])).parquet(folder)
        return written.groupBy(F.col("_metadata.file_path").alias("file"), "key_range").agg(
            F.min(self.key).cast("long").alias("first_key"),
            F.max(self.key).cast("long").alias("last_key"),
            F.count("*").alias("rows"),
        )

    def _commit(self, base: int, manifest: DataFrame) -> int:
        named = f"manifests/{uuid.uuid4().hex}"
        manifest.select("file", "key_range", "first_key", "last_key", "rows").write.parquet(f"{self.folder}/{named}")
        # Not to overwrite is what makes one of two writers fail; an empty file is a version not yet written.
        try:
            out = self._files().create(self._path("versions", str(base + 1)), False)
        except Exception as error:
            raise StaleBase(f"version {base + 1} exists already") from error
        out.write(bytearray(f"{named}\n".encode()))
        out.close()
        return base + 1

    def replace(self, rows: DataFrame, order: Sequence[str | Column], base: int | None = None) -> int:
        """A full refresh: the table holds `rows` only, of each key the last in `order`. Returns the new version."""
        base = self.version() if base is None else base
        return self._commit(base, self._write(latest_per_key(checkpointed(rows), [self.key], order)))

    def changes(self, incoming: DataFrame, order: Sequence[str | Column], base: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows of `incoming` that differ from what the table holds, of each key the last in `order`; the rows they replace).

        Only files of ranges that incoming keys fall into are read.
        """
        newest = checkpointed(latest_per_key(checkpointed(incoming.select(*self.schema.names)), [self.key], order))
        asked = newest.select(self._range().alias("key_range")).distinct()
        current = self._rows_of(self.manifest(base).join(asked, "key_range", "left_semi"))
        same = [F.col(c).eqNullSafe(F.col(f"now__{c}")) for c in self.schema.names]
        held = current.select(*[F.col(c).alias(f"now__{c}") for c in self.schema.names])
        changed = checkpointed(newest.join(held, same, "left_anti"))
        return changed, checkpointed(current.join(changed.select(self.key), self.key, "left_semi"))

    def upsert(self, incoming: DataFrame, order: Sequence[str | Column], base: int | None = None) -> int:
        """Whole-row replacement by key, new keys inserted. Returns the version after it, which is the one before if nothing changes.

        Ranges without a changed row keep their files. Raises StaleBase if the table moved on from `base`.
        """
        base = self.version() if base is None else base
        changed, _ = self.changes(incoming, order, base)
        return self.apply(changed, base)

    def apply(self, changed: DataFrame, base: int, gone: DataFrame | None = None) -> int:
        """Commit changed rows (unique keys, stored) and take out the keys of `gone`."""
        keys = changed.select(self.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key)).distinct()
        touched = checkpointed(keys.select(self._range().alias("key_range")).distinct())
        if touched.isEmpty():
            return base
        before = self.manifest(base)
        rest = self._rows_of(before.join(touched, "key_range", "left_semi")).join(keys, self.key, "left_anti")
        written = self._write(rest.unionByName(changed.select(*self.schema.names)))
        return self._commit(base, before.join(touched, "key_range", "left_anti").unionByName(written))

    def vacuum(self, keep: int = 1) -> None:
        """Delete files that none of the newest `keep` versions uses. Not while a writer or a reader of an older one is at work."""
        newest = self.version()
        used = {r.file.rsplit("/", 1)[-1] for v in range(max(1, newest - keep + 1), newest + 1) for r in self.manifest(v).collect()}
        files = self._files()
        found = files.listFiles(self._path("data"), True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().startswith("part-") and path.getName() not in used:
                files.delete(path, False)
        for version in range(1, newest - keep + 1):
            files.delete(self._path("versions", str(version)), False)
