"""A keyed store in files: upserts by batch, snapshots, compaction by bucket.

A key's rows go to one of ``buckets`` buckets.  Every batch writes its rows, the latest of
each key, as a delta of files by bucket, and then one manifest: the next version, with
the list of files of each bucket and the batches that are in.  A manifest is written
whole under another name and renamed, so a reader sees a version or does not; what no
manifest names does not exist.  A batch that is in already changes nothing.  Of a key
the row of greatest ``order`` counts (ties: of the greatest batch), so batches may come
late or twice and give the same store.  Buckets of more than ``most_files`` deltas are
merged into one, the others stay as they are.

One writer at a time: a second one finds its version taken and fails.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS, MOST_FILES = 16, 8


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS, most_files: int = MOST_FILES):
        self.spark, self.path, self.key, self.order, self.buckets, self.most_files = spark, path.rstrip("/"), key, order, buckets, most_files
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # -- manifests -----------------------------------------------------------------
    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        system, folder = self._system(), self._file("_versions")
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """files (bucket to paths, oldest first), batches (to the milliseconds each took), schema."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "files": {}, "batches": {}, "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).first()["value"])

    def _commit(self, manifest: dict) -> None:
        system, version = self._system(), manifest["version"]
        own, final = self._file(f"_versions/_{uuid.uuid4().hex}"), self._file(f"_versions/{version:010d}.json")
        if system.exists(final):
            raise RuntimeError(f"version {version} was written by another writer")
        out = system.create(own, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not system.rename(own, final):
            raise RuntimeError(f"version {version} could not be written")

    # -- reading -------------------------------------------------------------------
    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        paths = [p for b, own in manifest["files"].items() if buckets is None or b in buckets for p in own]
        return self.spark.read.schema(manifest["schema"]).parquet(*[f"{self.path}/{p}" for p in paths])

    def _latest(self, rows: DataFrame) -> DataFrame:
        newest = Window.partitionBy(self.key).orderBy(F.col(self.order).desc_nulls_last(), F.desc("_batch"))
        return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def read(self, version: int | None = None) -> DataFrame:
        """One row per key, as of a version (the newest if none is given)."""
        found = self.manifest(version)
        if not found["files"]:
            raise ValueError("the store is empty")
        return self._latest(self._rows(found)).drop("_batch")

    def batch(self, number: int) -> DataFrame:
        """The rows that a batch wrote and that still are the latest of their keys."""
        return self._latest(self._rows(self.manifest())).filter(F.col("_batch") == number).drop("_batch")

    # -- writing -------------------------------------------------------------------
    def upsert(self, rows: DataFrame, number: int) -> bool:
        """Put a batch in; False if it is in already."""
        now = self.manifest()
        if str(number) in now["batches"]:
            return False
        began = time.monotonic()
        rows = self._latest(rows.withColumn("_batch", F.lit(number).cast("long")))
        files = {b: [*own] for b, own in now["files"].items()}
        for bucket, path in self._write(rows, f"delta-{number}"):
            files.setdefault(bucket, []).append(path)
        schema = now["schema"] or self._ddl(rows)
        merged = self._merged({"files": files, "schema": schema})
        batches = {**now["batches"], str(number): round(1000 * (time.monotonic() - began))}
        self._commit({"version": now["version"] + 1, "files": merged, "batches": batches, "schema": schema})
        return True

    @staticmethod
    def _ddl(rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def _write(self, rows: DataFrame, name: str) -> list[tuple[str, str]]:
        """Rows by bucket below a folder of their own: (bucket, path)."""
        folder = f"{name}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets))
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._system().listStatus(self._file(folder))]
        return [(n.partition("=")[2], f"{folder}/{n}") for n in names if n.startswith("_bucket=")]

    def _merged(self, found: dict) -> dict:
        """Files of every bucket after the crowded ones are written anew."""
        crowded = {b for b, own in found["files"].items() if len(own) > self.most_files}
        if not crowded:
            return found["files"]
        whole = self._latest(self._rows(found, crowded))
        return {**found["files"], **{b: [p] for b, p in self._write(whole, "base")}}

    def clean(self, keep: int = 2) -> int:
        """Delete files that none of the newest ``keep`` versions names; how many folders went."""
        system, newest = self._system(), self.version()
        versions = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        used = {p.split("/")[0] for m in versions for own in m["files"].values() for p in own}
        gone = [f.getPath() for f in system.listStatus(self._file("")) if f.isDirectory() and not f.getPath().getName().startswith("_") and f.getPath().getName() not in used]
        for p in gone:
            system.delete(p, True)
        return len(gone)
