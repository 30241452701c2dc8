"""A keyed table in hash buckets, of which an upsert writes only those that it touches; and page snapshots that land once.

Layout: `data/<version>-<id>/__bucket=<n>` holds a bucket as some version wrote it, `manifests/<version>` names, in one
small JSON file, the folder of every bucket.  A version counts from the moment its manifest has its name, which a rename gives; before
that nothing refers to what it wrote.  So readers keep a whole version, and a batch that fails leaves the last one.

One writer at a time, as a stream's foreachBatch is.  Null keys are one key; an empty batch makes no version.  Of rows of equal key the
greatest in `order` stays, among equal ones that of the later batch, then that of the greatest hash.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import materialize, release

BUCKET, AGE = "__bucket", "__age"


@dataclass
class Manifest:
    version: int = 0
    batch: int | None = None
    schema: dict | None = None
    folders: dict[str, str] = field(default_factory=dict)


class BucketStore:
    """Rows by `key`, the greatest in `order` of each, under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> Manifest:
        """The last version, or one without folders."""
        whole = [n for n in self._names("manifests") if n.isdigit()]
        if not whole:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{whole[-1]}", wholetext=True).first()[0]))

    def _commit(self, manifest: Manifest) -> None:
        fs, name = self._fs(), f"{manifest.version:012d}"
        part = self._at("manifests", f"part-{name}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(vars(manifest)).encode()))
        out.close()
        if fs.exists(self._at("manifests", name)) or not fs.rename(part, self._at("manifests", name)):
            fs.delete(part, False)
            raise RuntimeError(f"version {manifest.version} of {self.path} was written by another writer")

    def _scan(self, manifest: Manifest, buckets: list[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in manifest.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(StructType.fromJson(manifest.schema)).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The rows of the last version; None before the first."""
        last = self.manifest()
        if last.schema is None:
            return None
        rows = self._scan(last)
        return self.spark.createDataFrame([], StructType.fromJson(last.schema)) if rows is None else rows

    def upsert(self, batch: DataFrame, batch_id: int | None = None) -> int | None:
        """Put a batch in; the number of the new version, or None where there was nothing to do: no rows, or a batch_id that is in already."""
        last = self.manifest()
        if batch_id is not None and last.batch is not None and batch_id <= last.batch:
            return None
        columns = batch.columns
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

        def newest(rows: DataFrame) -> DataFrame:
            rank = F.struct(F.col(self.order), F.col(AGE), F.xxhash64(*columns))
            return rows.groupBy(BUCKET, F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*columns, AGE), rank).alias("__row")).select(BUCKET, "__row.*")

        fresh = materialize(newest(batch.select("*", bucket, F.lit(1).alias(AGE))), "fresh")
        touched = [str(r[0]) for r in fresh.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            release(fresh)
            return None
        before = self._scan(last, touched)
        rows = fresh if before is None else newest(fresh.unionByName(before.select("*", bucket, F.lit(0).alias(AGE))))
        folder = f"{last.version + 1:012d}-{uuid.uuid4().hex}"
        rows.drop(AGE).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        schema = batch.schema.jsonValue() if last.schema is None else last.schema
        self._commit(Manifest(last.version + 1, last.batch if batch_id is None else batch_id, schema, last.folders | dict.fromkeys(touched, folder)))
        release(fresh)
        return last.version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last `keep` manifests, and the buckets that none of those names, what failed batches left included; returns how many buckets went."""
        fs, whole = self._fs(), [n for n in self._names("manifests") if n.isdigit()]
        for n in whole[:-keep]:
            fs.delete(self._at("manifests", n), False)
        texts = self.spark.read.text([f"{self.path}/manifests/{n}" for n in whole[-keep:]], wholetext=True).collect() if whole else []
        held = {(f, b) for r in texts for b, f in json.loads(r[0])["folders"].items()}
        gone = 0
        for folder in self._names("data"):
            buckets = [n.removeprefix(f"{BUCKET}=") for n in self._names(f"data/{folder}") if n.startswith(BUCKET)]
            unused = [b for b in buckets if (folder, b) not in held]
            for b in unused if len(unused) < len(buckets) else ():
                fs.delete(self._at("data", folder, f"{BUCKET}={b}"), True)
            if len(unused) == len(buckets):
                fs.delete(self._at("data", folder), True)
            gone += len(unused)
        return gone


def to_fetch(store: BucketStore, wanted: DataFrame, refresh: Column | None = None) -> DataFrame:
    """The rows of `wanted` whose key has no snapshot, or for which `refresh`, a condition on them, asks for a new one."""
    have = store.read()
    if have is None:
        return wanted
    again = F.lit(False) if refresh is None else F.coalesce(refresh, F.lit(False))
    marked = wanted.withColumn("__again", again)
    known = have.select(F.col(store.key).alias("__have"))
    missing = marked.filter("NOT __again").join(known, F.col(store.key).eqNullSafe(F.col("__have")), "left_anti")
    return missing.unionByName(marked.filter("__again")).drop("__again")


def land(store: BucketStore, pages: DataFrame, content: str) -> int | None:
    """Store pages that are new or have changed, by their hash, with the number of the landing; None where all are stored as they are.

    The store's order is the column `landed`, which this adds beside `sha`.  Of the store only keys and hashes are read to decide.
    """
    turn = store.manifest().version + 1
    rows = pages.select("*", F.sha2(F.col(content).cast("binary"), 256).alias("sha"), F.lit(turn).cast("long").alias("landed"))
    have = store.read()
    if have is not None:
        known = have.select(F.col(store.key).alias("__have"), F.col("sha").alias("__sha"))
        rows = rows.join(known, F.col(store.key).eqNullSafe(F.col("__have")) & F.col("sha").eqNullSafe(F.col("__sha")), "left_anti")
    return store.upsert(rows)
