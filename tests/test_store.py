"""The keyed store against a dictionary; what a save touches, and saves that are cut short or come twice."""

import os
import random

from gridloom.streaming.store import KeyedStore

RECORD = "doc_id string, n int"


def held(store):
    rows = store.rows()
    return {} if rows is None else {r["doc_id"]: r["n"] for r in rows.collect()}


def test_equals_a_dictionary(spark, tmp_path):
    draw, store, want = random.Random(5), KeyedStore(spark, f"{tmp_path}/s", "doc_id", 4), {}
    assert held(store) == {}
    for number in range(8):
        new = {draw.choice([None, *"abcdefgh"]): draw.randrange(99) for _ in range(draw.choice([0, 1, 4]))}
        gone = draw.sample([None, *"abcdefgh"], draw.choice([0, 2, 9]))
        store.put(spark.createDataFrame(list(new.items()), RECORD), number, spark.createDataFrame([(k,) for k in gone], "doc_id string"))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert held(store) == want
        if number == 5:
            store.compact()
            assert held(store) == want and len(os.listdir(f"{tmp_path}/s/commits")) == 1
    store.clear()
    assert held(store) == {}


def test_a_save_touches_its_buckets(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "doc_id", 16)
    store.put(spark.createDataFrame([(str(i), i) for i in range(200)], RECORD), 0)
    before = store.generations()
    store.put(spark.createDataFrame([("7", -7)], RECORD), 1)
    after = store.generations()
    assert len(before) == 16 and sum(before[b] != after[b] for b in after) == 1
    assert held(store) == {str(i): -7 if i == 7 else i for i in range(200)}
    files = store.rows().inputFiles()
    store.compact()
    assert sorted(store.rows().inputFiles()) == sorted(files) and sum(at == 1 for at, _ in store.generations().values()) == 1


def test_cut_short_and_twice(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "doc_id", 2)
    store.put(spark.createDataFrame([("a", 1)], RECORD), 0)
    spark.createDataFrame([("a", 9, 0), ("b", 9, 1)], f"{RECORD}, store_bucket int").write.partitionBy("store_bucket").parquet(f"{tmp_path}/s/data/generation=1")
    assert held(store) == {"a": 1}
    store.put(spark.createDataFrame([("b", 2)], RECORD), 1)
    store.put(spark.createDataFrame([("b", 3)], RECORD), 1)
    assert held(store) == {"a": 1, "b": 2}
