import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import topk


def brute(rows, is_query, k):
    v = []
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, (i, x) in enumerate(v):
        if is_query(i):
            scores = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(v) if b != a and len(x) == len(y))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(seed, n, d=8):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] + [1.0] * (d - 1)), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (n + 4, [0.0] * d), (n + 5, [1e6] * d)]
    return rows + [(n + 6, rows[0][1]), (n + 7, rows[0][1]), (50, rows[50][1])]


@pytest.mark.parametrize("sizes", [(8192, 512), (40, 7)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rows = vectors(1, 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    out = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, out.collect())) == brute(rows, lambda i: i % 5 == 0, 5)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(topk.integer_vectors(one), F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 256 * 5)]
    assert topk.top_k(topk.integer_vectors(one.limit(0)), F.col("vec_id") == 0).count() == 0


def test_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.standard_normal((3000, 6)) ** 3).astype(np.int64)
    ids = rng.permutation(3000)
    found = topk.threshold_search(v, ids, ids, v[:40], ids[:40], 5)
    for i, (places, scores) in enumerate(found):
        s = v @ v[i]
        s[i] = -(2**62)
        best = np.lexsort((ids, -s))[:5]
        assert ids[places].tolist() == ids[best].tolist() and [int(x) for x in scores] == s[best].tolist()


def test_reads_on_until_the_bound_stops_it():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.standard_normal((6000, 2))).astype(np.int64)
    v[:2000] = [2560, 0]  # equal values at the head of a list: no bound falls before depth 2000
    ids, asks = np.arange(6000), np.array([[256, 1], [256, -1]])
    stops = []
    found = topk.threshold_search(v, ids, ids, asks, np.array([-1, -1]), 5, stops=stops)
    assert all(256 < depth < 6000 and scored < 6000 for depth, scored in stops)
    for q, (places, scores) in zip(asks, found):
        s = v @ q
        best = np.lexsort((ids, -s))[:5]
        assert places.tolist() == best.tolist() and [int(x) for x in scores] == s[best].tolist()


def test_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 5.0]), (3, [1.0, 1.0]), (4, [3e38, 3e38])]
    out = topk.top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") == 0, k=4).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1), (2, -(2**63))]
