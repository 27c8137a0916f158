"""Records by key on the shared file system, for sessions and streams that save a few of many at a time.

Keys are hashed to buckets, and each bucket has generations of its own. A save rewrites the buckets that its keys
fall into and no others, under its own number; a commit, written last, names them. A reader takes each bucket's last
committed generation, so that it sees a save as a whole or not at all, and reads no older one.

    path/data/generation=G/store_bucket=B    a bucket as of save G
    path/commits/save_G, path/commits/upto_G    bucket, at (its last generation), full (whether it has rows)

Saves come one after another, by ascending numbers, as a stream's batches do. A number up to the last committed one
counts as done; one that was cut short before its commit is written anew. What comes to the driver is a row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, GENERATION = "store_bucket", "generation"
COMMIT = "bucket int, at long, full boolean"


@dataclass(frozen=True)
class KeyedStore:
    """One record per key; null is a key like any other. The number of buckets holds for the store's life."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def _hadoop(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _names(self, *parts: str) -> list[str]:
        files, where = self._hadoop(*parts)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def _delete(self, *parts: str) -> None:
        files, where = self._hadoop(*parts)
        files.delete(where, True)

    def generations(self) -> dict[int, tuple[int, bool]]:
        """bucket: (its last committed generation, whether it has rows)."""
        names = [n for n in self._names("commits") if n.startswith(("save_", "upto_"))]
        if not names:
            return {}
        commits = self.spark.read.schema(COMMIT).parquet(*[f"{self.path}/commits/{n}" for n in names])
        return {r["bucket"]: (r["at"], r["full"]) for r in commits.groupBy("bucket").agg(F.max("at").alias("at"), F.max_by("full", "at").alias("full")).collect()}

    def _read(self, found: dict[int, tuple[int, bool]]) -> DataFrame | None:
        folders = [f"{self.path}/data/{GENERATION}={at}/{BUCKET}={b}" for b, (at, full) in found.items() if full]
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*folders).drop(GENERATION, BUCKET)

    def rows(self) -> DataFrame | None:
        """The record of each key; None for a store without records."""
        return self._read(self.generations())

    def put(self, records: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Save records, one per key, in the place of what their keys had, and drop the keys of gone. A key in both is
        saved. Columns that one side lacks are null there. Without records and keys nothing is written."""
        if taken := {BUCKET, GENERATION} & set(records.columns):
            raise ValueError(f"the store keeps columns of its own under the names {sorted(taken)}")
        now = self.generations()
        if number <= max((at for at, _ in now.values()), default=-1):
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        records = records.withColumn(BUCKET, bucket).persist()
        keys = records.select(self.key, BUCKET)
        if gone is not None:
            keys = keys.unionByName(gone.select(self.key).withColumn(BUCKET, bucket))
        touched = {r[0] for r in keys.select(BUCKET).distinct().collect()}  # at most a number per bucket
        if touched:
            old, new = self._read({b: now[b] for b in touched & now.keys()}), records
            if old is not None:
                old = old.withColumn(BUCKET, bucket)
                replaced = keys.select(F.col(self.key).alias("store_key"))
                new = old.join(replaced, F.col(self.key).eqNullSafe(F.col("store_key")), "left_anti").unionByName(records, allowMissingColumns=True)
            data = f"{self.path}/data/{GENERATION}={number}"
            new.hint("rebalance", BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(data)
            full = {int(n.rpartition("=")[2]) for n in self._names("data", f"{GENERATION}={number}") if n.startswith(f"{BUCKET}=")}
            self._commit(f"save_{number}", {b: (number, b in full) for b in touched})
        records.unpersist()

    def _commit(self, name: str, found: dict[int, tuple[int, bool]]) -> None:
        rows = self.spark.createDataFrame([(b, at, full) for b, (at, full) in found.items()], COMMIT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def compact(self) -> None:
        """Merge the commits into one and delete what no bucket's last generation needs, saves that were cut short too.
        Records are not rewritten. Not to be run beside a save, or beside readers that began before the last one."""
        now = self.generations()
        if not now:
            return
        merged = f"upto_{max(at for at, _ in now.values())}"
        if merged not in (names := self._names("commits")):
            self._commit(merged, now)
        for name in names:
            if name != merged:
                self._delete("commits", name)
        live = {(f"{GENERATION}={at}", f"{BUCKET}={b}") for b, (at, full) in now.items() if full}
        for generation in self._names("data"):
            if generation not in {g for g, _ in live}:
                self._delete("data", generation)
                continue
            for part in self._names("data", generation):
                if part.startswith(BUCKET) and (generation, part) not in live:
                    self._delete("data", generation, part)

    def clear(self) -> None:
        self._delete()
