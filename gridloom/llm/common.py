"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: White space to ``str.split`` that does not separate words here.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """The words of a text, in order."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


#: Bytes of an Arrow batch, unless the session sets a size of its own: a worker holds as much of its input, or one longer text.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers are handed at once by bytes; rows alone bound nothing where texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A name for a helper column that no column of ``frames`` has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder, spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later stages survive lost executors without recomputing the past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: For tables whose rows take megabytes: the writer looks at what it holds after every row, not after a hundred, and closes a group of rows
#: beyond 8 MB, which is also as much as a reader opens at once.
LARGE_ROWS = {"parquet.block.size": 1 << 23, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write a bulky intermediate as Parquet to the shared folder and read it back; options: of the writer.

    Like cut(), but columnar and compressed. The files go when the program ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rewritten(df: DataFrame, step) -> DataFrame:
    """materialize(step(materialize(df))), without the first table once the second is written: nothing reads it again."""
    table = materialize(df)
    mine = _TABLES[-1]
    out = materialize(step(table))
    delete(*mine)
    _TABLES.remove(mine)
    return out


@atexit.register
def drop_tables() -> None:
    """Delete what materialize() has written, while the session still runs."""
    while _TABLES:
        with contextlib.suppress(Exception):  # the session may have gone
            delete(*_TABLES.pop())


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find it filled."""
    module = sys.modules.setdefault("_gridloom_worker", types.ModuleType("_gridloom_worker"))
    return module.__dict__.setdefault(name, {})


def drop_worker_caches() -> None:
    """Forget what earlier stages have left in this worker: for stages that need the memory and none of it."""
    if sys.modules.pop("_gridloom_worker", None) is not None:
        gc.collect()
