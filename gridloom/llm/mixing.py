"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, in a pseudorandom order of its documents, form blocks of equal length. Each
output shard draws from a multinomial how many blocks it takes from each source; a source's draws are
numbered through all shards, and number j takes block permutation(j mod blocks) of pass j div blocks.
The odds of a shard's draw are what each source still lacks of its target, so that the noise of the
shards before it is made good, and at the end only that of the last draw is left.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, load, materialize, shuffle_partitions

#: Least words of a block, and blocks that a mix has at most: beyond, all blocks get longer.
BLOCK, BLOCKS = 64, 1 << 28
#: Output shards (at least and at most) and the slots of one between; most passes over a source.
SHARDS, SLOTS, PASSES = (64, 1024), 1 << 16, 3
#: Rows of a hash bucket of a source, about, and least buckets. Sources up to which their table is broadcast.
BUCKET_ROWS, BUCKETS, FEW = 50_000, 512, 10_000


def targets(sizes: list[int], weights: list[int], passes: int = PASSES) -> list[float]:
    """Shares of the total by weight, none above ``passes`` times its source; what that cuts off is
    shared among the others by weight, until none is above."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = float(sum(sizes))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > passes * sizes[i]}
        for i in full or open_:
            out[i] = float(passes * sizes[i]) if full else level * weights[i]
            left -= out[i]
        open_ = open_ - full if full else set()
    return out


def permute(j: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), at j: four Feistel rounds on the next even number of
    bits, repeated for values of n and above until they fall below it."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        h, m, s = half[todo], mask[todo], seed[todo].astype(np.uint64)
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (b + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, (a ^ (f >> np.uint64(31))) & m
        x[todo] = (a << h) | b
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def draw_counts(want: np.ndarray, most: np.ndarray, seed: int) -> np.ndarray:
    """shards x sources: blocks that each output shard takes of each source, multinomial draws.

    want: expected blocks of each source; most: blocks it can give. Draws above that are drawn anew
    among the sources that have blocks left.
    """
    slots = int(min(round(float(want.sum())), most.sum()))
    shards = min(max(slots, 1), SHARDS[1], max(SHARDS[0], slots // SLOTS))
    out = np.zeros((shards, len(want)), np.int64)
    draw, given = np.random.default_rng(seed), np.zeros(len(want), np.int64)
    for shard in range(shards):
        left = slots * (shard + 1) // shards - slots * shard // shards
        while left:
            odds = np.where(given < most, np.maximum(want - given, 0), 0)
            if not odds.sum() > 0:
                odds = (most - given).astype(float)
            n = draw.multinomial(left, odds / odds.sum())
            n = np.minimum(n, most - given)
            out[shard] += n
            given += n
            left -= int(n.sum())
    return out


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def taken_blocks(source_rows: list, block: int, seed: int, spark: SparkSession) -> DataFrame:
    """k, block, pass: the blocks that the mix takes. source_rows: (size, target) of source k, in order."""
    blocks = np.array([-(-size // block) for size, _ in source_rows], np.int64)
    want = np.array([t * b / s if s else 0.0 for (s, t), b in zip(source_rows, blocks)])
    counts = draw_counts(want, PASSES * blocks, seed)
    first = np.cumsum(counts, axis=0) - counts
    shard, k = np.nonzero(counts)
    drawn = pd.DataFrame({"shard": shard, "k": k.astype(np.int32), "n": counts[shard, k], "first": first[shard, k], "blocks": blocks[k]})
    drawn = spark.createDataFrame(drawn, "shard long, k int, n long, first long, blocks long")  # SHARDS rows of each source at most
    tasks = max(shuffle_partitions(spark), int(counts.sum()) // SLOTS)  # a number that is given is kept: the rows are few but hold many slots
    slot = drawn.repartition(tasks, "shard", "k").select("k", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j"))

    @F.pandas_udf("long")
    def place(j: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(permute(j.to_numpy(), n.to_numpy(), k.to_numpy() + 1 + seed))

    return slot.select("k", place(F.col("j") % F.col("blocks"), "blocks", "k").alias("block"), F.floor(F.col("j") / F.col("blocks")).cast("int").alias("pass"))


def mix(docs: DataFrame, weights=(1, 2, 3), seed: int = 8, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    docs: doc_id, text, source, and if numbered a unique long uid; other columns are not read. documents: uid, doc_id,
    source, size, source_size, target, taken, a row for every row of docs. pieces: uid, pass, lo, hi: words lo to hi of
    a document that the mix takes in that pass. Sources in code point order, null last and a source of its own, have
    the weights in turn. A text without words, or null, has size 0 and nothing taken; long texts are many blocks.
    Repeated rows are documents of their own. Documents stand in an order of hashes, equal ones (ties) in order of
    doc_id, size and row. One row per source reaches the driver. An empty table gives empty results.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs, "uid") if numbered else sized(docs).withColumn("uid", F.monotonically_increasing_id()))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    goal = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))])
    length = max(BLOCK, -(-sum(r["size"] for r in found) // BLOCKS))
    buckets = max(BUCKETS, max((r["n"] for r in found), default=0) // BUCKET_ROWS)
    source = spark.createDataFrame([(k, r["source"], r["size"], t) for k, (r, t) in enumerate(zip(found, goal))], "k int, name string, source_size long, target double")
    source = F.broadcast(source) if len(found) <= FEW else source.hint("merge")
    rows = rows.join(source, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumns({"h": F.xxhash64("doc_id", F.lit(seed)), "bucket": F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.lit(buckets))})
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("b"))
    sums = sums.select("k", "bucket", (F.sum("b").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")).alias("base"))
    inside = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(inside)).join(sums.hint("merge"), ["k", "bucket"])
    rows = rows.select("uid", "doc_id", "source", "size", "source_size", "target", "k", (F.col("base") + F.col("end") - F.col("size")).alias("start"))
    block = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)))
    parts = rows.where("size > 0").select("uid", "k", "start", "size", block.alias("block"))
    parts = parts.select(
        "uid", "k", "block",
        (F.greatest(F.col("start"), F.col("block") * length) - F.col("start")).alias("lo"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.col("start")).alias("hi"),
    )
    pieces = parts.join(taken_blocks([(r["size"], t) for r, t in zip(found, goal)], length, seed, spark).hint("merge"), ["k", "block"]).select("uid", "pass", "lo", "hi")
    taken = pieces.groupBy("uid").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    documents = rows.join(taken.hint("merge"), "uid", "left").select("uid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, pieces


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), seed: int = 8) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: a row for each document and pass that takes
    words of it, its text being those words as they stand (parts that do not touch joined by a line break), n_chars made
    to fit if present. Documents of which nothing is taken, null and empty texts among them, are not in the mix. See mix()."""
    uid, parts, turn = fresh("uid", docs), fresh("taken pieces", docs), fresh("pass", docs)
    numbered = materialize(docs.withColumn(uid, F.monotonically_increasing_id()))
    size = len(docs.columns)
    _, pieces = mix(numbered.select(F.col(uid).alias("uid"), "doc_id", "text", "source"), weights, seed, numbered=True)
    taken = pieces.groupBy(F.col("uid").alias(uid), F.col("pass").alias(turn)).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias(parts))  # as many as a text has blocks
    rows = numbered.join(taken.hint("merge"), uid).drop(uid, turn)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                names = part.schema.names[:size]
                texts = [excerpt(t, p) for t, p in zip(part.column(at).to_pylist(), part.column(size).to_pylist())]
                new = {"text": texts, "n_chars": [len(t) for t in texts]}
                yield pa.RecordBatch.from_arrays([pa.array(new[c.lower()], part.schema.field(i).type) if c.lower() in new else part.column(i) for i, c in enumerate(names)], names)

    return rows.mapInArrow(run, docs.schema)


def excerpt(text: str, taken: list[dict]) -> str:
    """Words lo to hi of each piece, as they stand in the text; pieces in order."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    merged: list[list[int]] = []
    for p in taken:
        if merged and merged[-1][1] == p["lo"]:
            merged[-1][1] = p["hi"]
        else:
            merged.append([p["lo"], p["hi"]])
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in merged)


def op8_multinomial_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(load(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")
