"""Space-filling-curve packing.

Each document's hashed bag of ids is projected to a few dimensions and quantized; the Hilbert key of
that point orders the corpus, so that neighbours on the curve have similar ids. The stream of ids in
that order is cut every ``length`` ids: sequences are full but for the last one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load
from .tokens import encoder, slices

#: Buckets of the hashed vectors, dimensions of the curve, bits of each.
BUCKETS, DIMS, BITS = 256, 4, 12
END_ID = 1


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of non-negative integers below 2 ** bits."""
    x = points.T.astype(np.int64)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the coarsest
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert key of each document. One without ids lies at the centre."""
    n = len(lengths)
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
    counts = np.bincount(np.repeat(np.arange(n), lengths) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)
    directions = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    spread = np.tanh((counts @ directions) / 2)
    return hilbert_key(np.clip(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def encode_for_curve(docs: DataFrame, file: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (ids with the end id), curve_key, ids (compressed little-endian uint32) per document."""

    def encode(batches):
        import zstandard

        enc, squeeze = encoder(file), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, lengths = enc.encode(texts[a:b])
                keys = curve_keys(ids, lengths)
                packed = []
                ends = np.cumsum(lengths)
                for lo, hi in zip((ends - lengths).tolist(), ends.tolist()):
                    packed.append(squeeze.compress(pack_ids(np.append(ids[lo:hi], np.uint32(end_id)))))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(lengths + 1, pa.int64()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "curve_key", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n long, curve_key long, ids binary")


def pack_ids(ids: np.ndarray) -> bytes:
    """Low halves of all ids, then the high halves: the latter are mostly zeros and compress away."""
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    halves = np.frombuffer(blob, "<u2").astype(np.uint32)
    n = len(halves) // 2
    return halves[:n] | (halves[n:] << 16)


def starts_along_curve(encoded: DataFrame) -> DataFrame:
    """uid, at: ids before each document along the curve.

    Rows are range-partitioned by (key, doc_id, uid), so many equal keys still spread; each partition
    sums its own rows, and the sums of the partitions before it (one number each) are added.
    """
    rows = encoded.select("uid", "doc_id", "curve_key", "n").repartitionByRange(F.col("curve_key"), F.col("doc_id"), F.col("uid")).sortWithinPartitions("curve_key", "doc_id", "uid")

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(3).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n)], ["uid", "part", "local", "n"])
            total = int(ends[-1]) if len(ends) else total

    rows = cut(rows.mapInArrow(run, "uid long, part int, local long, n long"))
    parts = rows.groupBy("part").agg(F.sum("n").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").select("uid", (F.col("local") + F.col("base")).alias("at"))  # one row per partition


def pack_along_curve(docs: DataFrame, file: str, length: int = 2048, with_ids: bool = False, with_row: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``length`` ids.

    docs: doc_id, text; a null text is empty, and an empty one has the end id alone. Repeated rows
    are packed once each. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, with_ids the piece's ids, and with_row a number of the row that it came from. An empty table gives no pieces.
    """
    encoded = cut(encode_for_curve(docs, file).withColumn("uid", F.monotonically_increasing_id()))
    placed = encoded.select("uid", "doc_id", "ids").join(starts_along_curve(encoded), "uid")

    def pieces(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            out, rows = [[] for _ in range(8)], []
            for doc_id, blob, at, uid in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = unpack_ids(unsqueeze.decompress(blob))
                start = 0
                while start < len(ids):
                    offset = (at + start) % length
                    part = ids[start : start + length - offset]
                    for column, v in zip(out, (doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), (at + start) // length, offset, part if with_ids else None)):
                        column.append(v)
                    rows.append(uid)
                    start += len(part)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            last = [pa.array(rows, pa.int64())] * with_row
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)] + last, names=NAMES[: len(kinds)] + ["row"] * with_row)

    schema = ", ".join(f"{x} long" for x in NAMES[:7]) + ", ids array<long>" * with_ids + ", row long" * with_row
    return placed.select("doc_id", "ids", "at", "uid").mapInArrow(pieces, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def op2_hilbert_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
