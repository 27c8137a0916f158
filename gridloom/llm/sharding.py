"""Minimum-cost-flow resharding.

Old shards hold some bytes each, new shards may hold some bytes each. The transfers that move the
fewest bytes are a minimum-cost flow on the bipartite graph of old and new shards, where bytes that
stay cost nothing. Only the shard sizes reach the driver: one number per shard. Rows travel in
blocks (hash buckets of an old shard, by doc_id and text), and a block goes whole to one new shard, so
that only files of shards with a transfer are rewritten.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of, cut, load

#: Blocks of each old shard. The block table has shards * BLOCKS rows, whatever the input.
BLOCKS = 1024


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow old x new of least total cost that ships every supply within the capacities.

    Successive shortest paths with labels corrected by a queue; the graph has one node per shard.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    source, sink = n + m, n + m + 1
    arcs: list[list[int]] = []  # [to, capacity left, cost]; arc k ^ 1 is the reverse of arc k
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: int, price: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, cap, price])
        out[b].append(len(arcs))
        arcs.append([a, 0, -price])
        return len(arcs) - 2

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    middle = [[arc(i, n + j, supply[i], cost[i][j]) for j in range(m)] for i in range(n)]
    left = sum(supply)
    while left:
        far, via, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                b, cap, price = arcs[k]
                if cap and far[a] + price < far.get(b, 1 << 62):
                    far[b], via[b] = far[a] + price, k
                    queue.append(b)
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(left, *(arcs[k][1] for k in path))
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
        left -= push
    return [[arcs[k ^ 1][1] for k in row] for row in middle]


def even(total: int, n: int) -> list[int]:
    """Capacities of n shards that share a total, at most one byte apart."""
    return [total // n + (i < total % n) for i in range(n)]


def size_of(text: Column) -> Column:
    """Bytes of the UTF-8 text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def transfers(spark: SparkSession, sizes: dict[int, int], capacity: list[int]) -> DataFrame:
    """Rows (old_shard, new_shard, lo, hi): the bytes lo to hi of an old shard go to new_shard.

    The part that stays comes first. The last interval of a shard is open, for rounding.
    """
    old = sorted(sizes)
    flow = min_cost_flow([sizes[i] for i in old], capacity, [[int(i != j) for j in range(len(capacity))] for i in old])
    rows = []
    for i, given in zip(old, flow):
        at = 0
        for j in sorted((j for j, f in enumerate(given) if f), key=lambda j: (j != i, j)) or [min(max(i, 0), len(capacity) - 1)]:
            rows.append([i, j, at, at + given[j]])
            at += given[j]
        rows[-1][3] = 1 << 62
    return spark.createDataFrame(rows, "old_shard int, new_shard int, lo long, hi long")


def reshard(docs: DataFrame, old_shard: Column, shards: int, capacity: list[int] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` new shards, moving the fewest bytes.

    docs: doc_id, text (other columns are ignored, whatever their names). old_shard: int expression
    over docs; null counts as shard 0. capacity: bytes of each new shard, by default even shares.
    Returns doc_id, size, text_crc32, old_shard, block, shard, slot; slots of a shard are gapless
    from 0, in order of old shard, block, doc_id, checksum and size (ties, which are equal rows, in any
    order). A null text has size 1 and the checksum of no bytes; texts of any length are only measured.
    Repeated rows each get a slot. An empty table gives an empty result. A shard misses its share by
    half a block at most per transfer, and a block holds at least one document.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
    )
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(blocks)).cast("int"))
    rows = cut(rows)
    block = cut(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sizes = {r[0]: r[1] for r in block.groupBy("old_shard").agg(F.sum("bytes")).collect()}
    plan = transfers(spark, sizes, capacity or even(sum(sizes.values()), shards))
    # Large blocks first: the part that stays is cut from them, transfers end within small ones.
    by_size = Window.partitionBy("old_shard").orderBy(F.desc("bytes"), "block")
    placed = block.withColumn("middle", F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("bytes") / 2) - 1)
    placed = placed.join(plan.hint("merge"), "old_shard").where("middle >= lo and middle < hi")
    before = Window.partitionBy("new_shard").orderBy("old_shard", "block")
    placed = placed.select("old_shard", "block", F.col("new_shard").alias("shard"), (F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(inside) - 1)
    return rows.join(placed, ["old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "block", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot")
    )


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Write the files of the shards that gain or lose rows to ``path``/shard=N; the others keep theirs.

    docs: doc_id, text and payload columns. plan: result of reshard() for docs; the nth of its rows of one
    doc_id, checksum and size stands for the nth such row of docs, so repeated rows stay as many. Payload
    columns named like the plan's are left out. A folder that is written replaces what was there, and that
    of a shard left without rows goes, so a rerun gives the same files. Returns one row per rewritten
    shard: shard, moved_bytes. Without a move nothing is written.
    """
    moved = plan.where("shard <> old_shard")
    touched = cut(moved.select(F.explode(F.array("shard", "old_shard")).alias("shard"), "size").groupBy("shard").agg(F.sum("size").alias("moved_bytes")))
    key = ["doc_id", "text_crc32", "size"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))).alias("nth")
    payload = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot", "old_shard", "block", "size", "text_crc32", "nth")], crc32_of(F.col("text")).alias("text_crc32"), size_of(F.col("text")).alias("size"))
    payload, names = payload.select("*", nth), payload.columns
    placed = plan.select(*key, "shard", "slot", nth).join(touched.select("shard").hint("merge"), "shard")
    same = placed["nth"] == payload["nth"]
    for k in key:
        same = same & placed[k].eqNullSafe(payload[k])
    rows = payload.join(placed, same).select(*[payload[c] for c in names if c not in ("text_crc32", "size")], placed["shard"], placed["slot"])
    rows = cut(rows)
    rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    for r in touched.join(rows.select("shard").distinct(), "shard", "left_anti").collect():  # a row per emptied shard
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={r['shard']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def op1_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, from shards by source (so a hot source overfills one) into 8 even shards."""
    docs = load(spark, sf_dir, "documents")
    placed = reshard(docs, F.pmod(F.xxhash64("source"), F.lit(8)), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block")
