"""Merging and upserting catalogs by recency."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.operators.errors import CatalogError
from lodeatlas.plans.session import cut

KEY = ("model_id", "provider")


def merge_models(static: DataFrame, cached: DataFrame, key: Sequence[str] = KEY, stamp: str = "last_synced") -> DataFrame:
    """Both catalogs by key; the cached row wins only with a strictly larger stamp (compared as text).

    One aggregate that combines before the shuffle decides; a predicate on the key reaches both scans.
    Of rows of one side with equal stamps the one that is larger by its values counts.
    """
    both = static.withColumn("_static", F.lit(1)).unionByName(cached.withColumn("_static", F.lit(0)))
    plain = [c for c in static.columns if c not in key]
    order = F.struct(F.coalesce(F.col(stamp), F.lit("")).alias("at"), "_static", *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(plain)])
    return both.groupBy(*key).agg(F.max_by(F.struct(*plain), order).alias("_row")).select(*key, "_row.*").select(*static.columns)


def latest(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row of each key that is largest by ``by``, then by its other values."""
    others = [c for c in rows.columns if c not in key and c not in by]
    order = F.struct(*by, *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(others)])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def default_store_path(spark: SparkSession) -> str:
    """The folder of the user's own catalog: under $XDG_CACHE_HOME, else ~/.cache. Only for a local session: the executors of a cluster have other homes."""
    if not spark.sparkContext.master.startswith("local"):
        raise CatalogError("name a folder that all executors share for the stored catalog")
    cache = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(cache, "lodeatlas", "models")


class CatalogStore:
    """A stored catalog in a folder: numbered versions, each with the buckets of keys that it changed.

    ``upsert`` replaces rows by key and stamps the whole batch with one time; it reads and writes only
    the buckets that the batch touches. The rows of a bucket are those of the newest whole version that
    has it, so a reader sees a version or doesn't; what was replaced stays until ``vacuum``. There is
    one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema_version: int = 4, buckets: int = 64):
        self.spark, self.path, self.schema_version, self.buckets = spark, path.rstrip("/"), schema_version, buckets

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        root = path(self.path)
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(path(s.getPath().toString() + "/_SUCCESS"))]
        return sorted(p.getName() for p in done)

    def newest(self) -> dict[int, str]:
        """The folder with the current rows of each bucket."""
        fs, path = self._fs()
        out: dict[int, str] = {}
        for version in self.versions():
            for s in fs.listStatus(path(f"{self.path}/{version}")):
                if s.getPath().getName().startswith("bucket="):
                    out[int(s.getPath().getName()[7:])] = s.getPath().toString()
        return out

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        """The current rows, or None while nothing was stored."""
        return self._read(list(self.newest().values()))

    def _write(self, rows: DataFrame) -> None:
        n = int(self.versions()[-1][1:9]) + 1 if self.versions() else 0
        # Several files for each bucket, so that a large bucket is no single task.
        rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*KEY, F.lit(1)), F.lit(16))).write.partitionBy("bucket").parquet(f"{self.path}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, batch: DataFrame, now: str) -> None:
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        fresh = cut(latest(batch.withColumn("last_synced", F.lit(now)), KEY, ["last_synced"]).withColumn("bucket", bucket))
        touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}
        old = self._read([folder for b, folder in self.newest().items() if b in touched])
        if old is None:
            if touched:
                self._write(fresh)
            return
        both = old.withColumns({"_new": F.lit(0), "bucket": bucket}).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        self._write(latest(both, KEY, ["_new"]).drop("_new"))

    def vacuum(self) -> None:
        """Remove the buckets that newer versions have replaced."""
        fs, path = self._fs()
        current = set(self.newest().values())
        for version in self.versions():
            for s in fs.listStatus(path(f"{self.path}/{version}")):
                if s.getPath().getName().startswith("bucket=") and s.getPath().toString() not in current:
                    fs.delete(s.getPath(), True)
