"""Legal changes and debounced saves: cases of one file, random logs, and a stream that is stopped and taken up again."""

import random
from datetime import datetime, timedelta

from gridloom.functions import vocab as V
from gridloom.streaming import checkpoints as K

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(milliseconds=round(seconds * 1000))


def found(df):
    return sorted((r["doc_id"], (r["at"] - START).total_seconds(), r["event_id"], r["kind"], r["status"], r["detail"]) for r in df.collect())


def log(spark, rows):
    return spark.createDataFrame([(d, at(t), i, s, r) for i, (d, t, s, r) in enumerate(rows)], K.EVENT)


def test_a_b_a_saves_three_times(spark):
    rows = [("f", 0, "pending", "A"), ("f", 5, "pending", "B"), ("f", 10, "pending", "A"), ("f", 15, "pending", "A")]
    assert found(K.outcomes(log(spark, rows))) == [("f", 1.2, 0, "saved", "pending", "A"), ("f", 6.2, 1, "saved", "pending", "B"), ("f", 11.2, 2, "saved", "pending", "A")]


def test_changes_within_the_rest_save_once(spark):
    rows = [("f", 0, "pending", "A"), ("f", 1, "pending", "B"), ("f", 2, "pending", "C"), ("f", 3.2, "pending", "D"), ("g", 0, "pending", None)]
    assert found(K.outcomes(log(spark, rows))) == [("f", 3.2, 2, "saved", "pending", "C"), ("f", 4.4, 3, "saved", "pending", "D"), ("g", 1.2, 4, "saved", "pending", None)]


def test_work_under_way_is_not_saved_and_illegal_changes_are_told(spark):
    rows = [("f", 0, "completed", "A"), ("f", 2, "converting", "A"), ("f", 4, "extracting", "A"), ("f", 6, "editing", "A"), ("f", 8, "detecting", "A"), ("f", 9, "nonsense", "A")]
    assert found(K.outcomes(log(spark, rows))) == [("f", 0, 0, "illegal", "completed", "pending"), ("f", 7.2, 3, "saved", "editing", "A"), ("f", 8, 4, "illegal", "detecting", "editing"), ("f", 9, 5, "illegal", "nonsense", "editing")]


def test_return_to_the_saved_record_leaves_the_wait(spark):
    rows = [("f", 0, "pending", "A"), ("f", 5, "pending", "B"), ("f", 5.5, "pending", "A"), ("f", 9, "pending", "A")]
    assert [r[1:3] for r in found(K.outcomes(log(spark, rows)))] == [(1.2, 0), (6.2, 1), (10.2, 3)]


def random_rows(draw, n):
    t, rows = 0.0, []
    for _ in range(n):
        t += draw.choice([0.1, 0.5, 1.2, 3])
        rows.append((draw.choice("abc"), t, draw.choice([*V.TRANSITIONS]), draw.choice("xyz")))
    return rows


def test_stream_with_restarts_equals_the_batch(spark, tmp_path):
    K.state_store(spark)
    rows = [*random_rows(random.Random(4), 60), ("tick", 1000, "pending", "end")]
    whole = log(spark, rows).orderBy("at").collect()
    for part, cut in enumerate(range(0, len(whole), 16)):
        spark.createDataFrame(whole[cut : cut + 16], K.EVENT).coalesce(1).write.parquet(f"{tmp_path}/log/{part}")
        stream = spark.readStream.schema(K.EVENT).parquet(f"{tmp_path}/log/*")
        query = K.saves(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(300)  # stopped here, taken up again by the next round
    expected = [r for r in found(K.outcomes(log(spark, rows))) if r[0] != "tick"]
    assert found(spark.read.parquet(f"{tmp_path}/out")) == expected and len(expected) > 20


def test_empty_log(spark):
    assert K.outcomes(spark.createDataFrame([], K.EVENT)).count() == 0
