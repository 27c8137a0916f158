import itertools
import zlib
from collections import Counter

from llm import corpus as C
import pytest
from pyspark.sql import functions as F

from gridloom.llm import sharding


def least_moved(supply, capacity):
    """Bytes moved by the best plan: all that does not fit where it is."""
    return sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


@pytest.mark.parametrize("supply,capacity", [([5, 0, 9], [4, 5, 5]), ([7, 7], [14]), ([10], [3, 3, 4]), ([1, 2, 3, 4], [4, 3, 2, 1]), ([0, 0], [1, 1])])
def test_flow_moves_the_fewest_bytes(supply, capacity):
    cost = [[int(i != j) for j in range(len(capacity))] for i in range(len(supply))]
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply
    assert all(sum(c) <= m for c, m in zip(zip(*flow), capacity))
    assert sum(f * c for r, s in zip(flow, cost) for f, c in zip(r, s)) == least_moved(supply, capacity)


def test_flow_of_any_cost_is_least():
    supply, capacity, cost = [2, 1], [1, 2], [[3, 1], [2, 5]]
    best = min(
        sum(f * c for f, c in zip((a, 2 - a, b, 1 - b), (3, 1, 2, 5)))
        for a, b in itertools.product(range(3), range(2))
        if a + b <= 1 and 3 - a - b <= 2
    )
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert sum(f * c for r, s in zip(flow, cost) for f, c in zip(r, s)) == best


def test_flow_needs_room():
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [2], [[0]])


def test_reshard(spark):
    docs = C.documents(spark)
    out = sharding.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(8)), 8).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in C.rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(8):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / 8) <= 8 * largest
    assert len({(r["old_shard"], r["block"], r["shard"]) for r in out}) == len({(r["old_shard"], r["block"]) for r in out})  # blocks go whole


def test_only_what_must_moves(spark):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(400)], "doc_id long, text string")
    out = sharding.reshard(docs, (F.col("doc_id") % 4).cast("int"), 4).collect()
    assert all(r["old_shard"] == r["shard"] for r in out)


def test_empty(spark):
    assert sharding.reshard(C.empty(spark), F.lit(0), 8).count() == 0


def test_rewrite(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9, i) for i in range(300)], "doc_id long, text string, shard int")
    plan = sharding.reshard(docs, F.when(F.col("doc_id") < 200, 0).when(F.col("doc_id") < 275, 1).otherwise(2), 3)
    moved = {r["shard"]: r["moved_bytes"] for r in sharding.rewrite_affected(docs, plan, str(tmp_path / "out")).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    where = {r["doc_id"]: r["shard"] for r in plan.collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == {d: s for d, s in where.items() if s in moved}
    assert set(moved) == {0, 1, 2} and back.columns.count("text") == 1


def test_slots_against_brute_force(spark):
    """Blocks of each old shard, largest first, cut where the flow says; then slots counted one by one."""
    docs = C.documents(spark)
    out = sorted(map(tuple, sharding.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(8)), 8).select("old_shard", "block", "doc_id", "text_crc32", "size", "shard", "slot").collect()), key=str)
    blocks = Counter()
    for r in out:
        blocks[r[0], r[1]] += r[4]
    supply = {i: sum(b for (o, _), b in blocks.items() if o == i) for i in {o for o, _ in blocks}}
    total, old = sum(supply.values()), sorted(supply)
    flow = sharding.min_cost_flow([supply[i] for i in old], [total // 8 + (j < total % 8) for j in range(8)], [[int(i != j) for j in range(8)] for i in old])
    home = {}
    for i, given in zip(old, flow):
        ends, at = [], 0
        for j in sorted((j for j in range(8) if given[j]), key=lambda j: (j != i, j)):
            at += given[j]
            ends.append((at, j))
        seen = 0
        for (_, b), size in sorted(((k, s) for k, s in blocks.items() if k[0] == i), key=lambda x: (-x[1], x[0][1])):
            seen += size
            middle = seen - size // 2 - 1
            home[i, b] = next((j for end, j in ends if middle < end), ends[-1][1])
    count = Counter()
    for o, b, d, crc, size, shard, slot in sorted(out, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4], r[6])):
        assert (shard, slot) == (home[o, b], count[shard])
        count[shard] += 1


def test_rewrite_again_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(i % 90, "x" * (i % 7), i) for i in range(300)] + [(None, None, 1), (None, None, 2), (5, "same", 3), (5, "same", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").withColumn("load", F.col("block"))
    plan = sharding.reshard(docs, F.when(F.col("load") < 200, 0).when(F.col("load") < 275, 1).otherwise(7), 3)
    for _ in range(2):
        moved = {r["shard"] for r in sharding.rewrite_affected(docs, plan, path).collect()}
        back = spark.read.parquet(path)
        assert sorted(r["load"] for r in back.collect()) == sorted(r[2] for r in rows) and {0, 1, 2, 7} == moved
        assert sorted({r["shard"] for r in back.collect()}) == [0, 1, 2]
