"""Streams of corrections and of file states: append-only logs, folded to what holds now.

Every fold is an aggregate by key with the engine's own state: run it in update mode, with a checkpoint
location on the shared file system. The same functions fold a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import latest_corrections
from ..operators.sessions import is_busy
from .store import KeyedStore

CORRECTION = "item_key string, at timestamp, event_id long, to_domain string"
STATE = "doc_id string, at timestamp, event_id long, status string"


def correction_log(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the corrections that are appended to a folder of Parquet files."""
    return spark.readStream.schema(CORRECTION).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_corrections(log: DataFrame) -> DataFrame:
    """item_key, to_domain, at, n: the last correction of each item so far."""
    return latest_corrections(log)


def current_states(log: DataFrame) -> DataFrame:
    """doc_id, status, at, resumed: the last state of each file, and the one from which a new session goes on."""
    last = log.groupBy("doc_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"))
    return last.withColumn("resumed", F.when(is_busy(F.col("status")), "pending").otherwise(F.col("status")))


def keep_current(current: DataFrame, path: str, checkpoint: str, key: str = "item_key", **trigger) -> StreamingQuery:
    """Save each batch of changed rows by key (store.py): a batch rewrites the buckets that its keys fall into.

    A batch that is run again after a failure counts once: it is skipped if it was committed, else written anew.
    """

    def put(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, key).put(batch, number)

    return current.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_rows(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Of each key the row of the last batch that had it; each bucket is read as of its last batch alone. None before the first."""
    return KeyedStore(spark, path, key).rows()
