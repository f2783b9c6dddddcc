"""Keyed tables with atomic upserts: hash buckets of Parquet files and numbered manifests that say which files are the table."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stelae.operators.joins import merge


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this one's remains."""


class KeyedTable:
    """Rows by key in the folder ``path``. A commit writes the touched buckets to a folder of its own and then renames a manifest to the next
    number, which succeeds once: readers see all of it or nothing, and those who hold an older manifest keep its files until ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _fs(self, where: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).startswith(prefix))

    def _rename(self, beside: str, name: str) -> bool:
        """False where the name is taken."""
        context = self.spark.sparkContext
        (fs, source), target = self._fs(beside), self._fs(name)[1]
        hadoop = context._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(source), fs.makeQualified(target), context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            return False
        return True

    def version(self) -> int:
        found = self._names("manifest=")
        return int(found[-1].split("=")[1]) if found else 0

    def _manifest(self, version: int) -> dict[int, str]:
        """Bucket to folder, at most one entry for each bucket."""
        if not version:
            return {}
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/manifest={version:09d}").collect()
        return {r.bucket: r.folder for r in rows}

    def _bucket(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(df[self.key]), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict[int, str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{f}/bucket={b}" for b, f in sorted(manifest.items())]) if manifest else None

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest by default."""
        rows = self._rows(self._manifest(self.version() if version is None else version))
        if rows is None:
            raise ValueError(f"{self.path} holds no table yet")
        return rows

    def _write(self, df: DataFrame, folder: str) -> None:
        """Buckets as folders; the rows of one are dealt over as many tasks as the shuffle has, so that a large bucket is several files."""
        df.withColumn("bucket", self._bucket(df)).repartition("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _commit(self, manifest: dict[int, str], version: int, folder: str) -> int:
        beside = f"_beside-{uuid.uuid4().hex}"
        lines = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, folder string")
        lines.coalesce(1).write.json(f"{self.path}/{beside}")
        if not self._rename(f"{self.path}/{beside}", f"{self.path}/manifest={version:09d}"):
            for name in (beside, folder):
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)
            raise Conflict(f"version {version} of {self.path} was committed by another writer")
        return version

    def upsert(self, new: DataFrame, preserve: list[str] | None = None, base: int | None = None) -> int:
        """Put rows by key and return the new version: those of ``new`` replace older ones, in ``preserve`` columns a null keeps the older
        value. Keys of ``new`` must be unique. Only the buckets of its keys are read and written. ``base`` is the version that the
        caller has seen; where another writer has gone past it, :class:`Conflict` is raised and the table stays as it was."""
        version = self.version() if base is None else base
        manifest, folder = self._manifest(version), f"data-{uuid.uuid4().hex}"
        touched = [r[0] for r in new.select(self._bucket(new).alias("b")).distinct().collect()]  # at most one row for each bucket
        old = self._rows({b: manifest[b] for b in touched if b in manifest})
        self._write(new if old is None else merge(old, new, self.key, preserve), folder)
        return self._commit(manifest | {b: folder for b in touched}, version + 1, folder)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the last ``keep`` and the folders that these do not name; returns the folders' names. Run it while nobody writes."""
        manifests = self._names("manifest=")
        live = {f for name in manifests[-keep:] for f in self._manifest(int(name.split("=")[1])).values()}
        gone = [n for n in self._names("data-") if n not in live]
        for name in [*gone, *manifests[:-keep], *self._names("_beside-")]:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
        return gone
