"""Sums against math.fsum, over shuffled rows and partitions."""

import math
import random

from gridloom.operators import sums


def test_sums_are_exact(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([1, -1]) * math.ldexp(draw.random(), draw.randint(-1074, 1020) if k == 2 else draw.randint(-60, 60))) for k in range(4) for _ in range(400)]
    rows += [(3, -v) for k, v in rows if k == 3]  # all of it cancels
    rows += [(5, 1e308), (5, 1e308), (5, -1e308), (6, 5e-324), (6, 5e-324), (7, None), (7, 0.0), (8, 0.1), *[(9, 0.1)] * 10, (10, 1e16), (10, 1.0), (10, -1e16)]
    want = {k: math.fsum(v for q, v in rows if q == k and v is not None) for k, _ in rows if k != 5} | {5: 1e308}
    for turn in range(2):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(3 + 8 * turn)
        assert {r["k"]: r["total"] for r in sums.exact_sums(df, "v", "k").collect()} == want
    merged = sums.accumulated(df.where("k < 2"), "v").union(sums.accumulated(df.where("k >= 2 and k <> 5"), "v")).groupBy("bin", "special").agg({"total": "sum"}).withColumnRenamed("sum(total)", "total")
    found = merged.selectExpr("collect_list(bin) as bins", "collect_list(cast(total as string)) as totals").select(sums.rounded("bins", "totals")).first()[0]
    assert found == math.fsum(v for k, v in rows if k != 5 and v is not None)


def test_what_is_no_number(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, inf), (1, 2.0), (2, inf), (2, -inf), (3, nan), (3, 1.0), (4, -inf), (5, 1.7e308), (5, 1.7e308)], "k int, v double")
    got = {r["k"]: r["total"] for r in sums.exact_sums(df, "v", "k").collect()}
    assert got[1] == inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == -inf and got[5] == inf
    assert sums.exact_sums(df.limit(0), "v").first()["total"] == 0
