"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into a grid of chunk pairs. Within a pair every dimension has its
candidates in order of value; a query reads the lists from the ends that its signs favour, all to the
same depth, and scores each new candidate. The values at that depth bound every unseen score, and
reading stops once the bound is below the kth best score found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load

#: Candidates and queries of a chunk.
CANDIDATES, QUERIES = 8192, 2048
#: What a long holds.
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1
#: First depth of sorted access at which the bound is tested, and how the depths grow to the lists' ends.
FIRST, GROWTH = 4, 2


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; vectors null or with null or non-finite ones are left out.

    A component beyond a long becomes the least or greatest long.
    """
    x = lambda e: e.cast("double")
    fine = F.forall(embedding, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    return rows.where(F.col(embedding).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda e: F.floor(x(e) * scale)).alias("v"))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def threshold_search(vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, stops: list | None = None):
    """For each query, the places of its k best rows of ``vectors`` and their scores.

    All integers. own holds the uid that a query leaves out. Scores are taken in double precision
    where every sum is exact in it, else in Python's integers. stops takes the depth at which each
    query stopped, and the rows that it scored.
    """
    n, d = vectors.shape
    exact = not n or not len(queries) or not d or np.abs(vectors.astype(float)).max() * np.abs(queries.astype(float)).max() * d < 2**52
    kind = np.float64 if exact else object
    v, q = vectors.astype(kind), queries.astype(kind)
    order = np.argsort(vectors, axis=0, kind="stable")  # the sorted lists, least first
    seen, met = np.zeros(n, bool), np.zeros(n, bool)
    out = [None] * len(q)
    for i in range(len(q)):
        up, down = np.flatnonzero(queries[i] > 0), np.flatnonzero(queries[i] < 0)
        places, scores, before, depth = np.empty(0, np.int64), np.empty(0, kind), 0, min(FIRST, n)
        while True:
            if depth < n:
                met[order[n - depth : n - before, up].ravel()] = True
                met[order[before:depth, down].ravel()] = True
                new = np.flatnonzero(met & ~seen)
            else:  # the ends of the lists, and rows of no list if all signs are 0
                new = np.flatnonzero(~seen)
            seen[new] = True
            new = new[uids[new] != own[i]]
            found = v[new] @ q[i]
            found = found if exact else np.minimum(np.maximum(found, LEAST_LONG), MOST_LONG)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, found])
            if depth >= n or seen.all():  # no row is left that the lists could still bring
                break
            bound = (q[i, up] * v[order[n - depth, up], up]).sum() + (q[i, down] * v[order[depth - 1, down], down]).sum()
            if len(scores) >= k and max(bound, LEAST_LONG) < np.partition(scores, len(scores) - k)[len(scores) - k]:
                break
            before, depth = depth, min(depth * GROWTH, n)
        seen[:] = met[:] = False
        best = best_of(scores, ids[places], k)
        out[i] = places[best], scores[best]
        if stops is not None:
            stops.append((depth, len(places)))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query row with every other row.

    vectors: vec_id, v (array of long). is_query: condition on vec_id. Ties go to the smaller vec_id.
    Rows of the same vec_id are rows of their own, and each query row has its own ranks. Vectors meet
    only vectors of the same length. Fewer others than k give fewer rows; an empty table gives none.
    A score beyond a long counts as the least or greatest long. Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", "v").withColumn("uid", F.monotonically_increasing_id()))
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    across, down = -(-n // CANDIDATES) or 1, -(-m // QUERIES) or 1
    chunk = lambda parts, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).cast("int")
    grid = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    size = F.size("v").alias("d")
    candidates = rows.select("vec_id", "v", "uid", size, F.lit(False).alias("asks"), chunk(across, 1).alias("c"), grid(down).alias("q"))
    queries = rows.where(is_query).select("vec_id", "v", "uid", size, F.lit(True).alias("asks"), chunk(down, 2).alias("q"), grid(across).alias("c"))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        matrix = np.stack(frame["v"].to_numpy()).astype(np.int64) if len(frame["v"].iloc[0]) else np.zeros((len(frame), 0), np.int64)
        ids, uids = frame["vec_id"].to_numpy(), frame["uid"].to_numpy()
        some, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(some) or not len(rest):
            return pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = threshold_search(matrix[rest], ids[rest], uids[rest], matrix[some], uids[some], k)
        return pd.concat(
            pd.DataFrame({"uid": uids[i], "query_id": ids[i], "vec_id": ids[rest][places], "score": [int(s) for s in scores]}, dtype="int64") for i, (places, scores) in zip(some, found)
        )

    each = candidates.unionByName(queries).groupBy("c", "q", "d").applyInPandas(pair, "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(load(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
