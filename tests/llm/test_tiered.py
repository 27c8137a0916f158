"""The tiered index against scores of every document."""

import math
import random
import re
from collections import Counter

from llm import corpus as C

from gridloom.llm import tiered as T

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for i, ts in terms:
            m, tf, score = 75 + 25 * len(ts) * n_docs // total, Counter(ts), 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def asked(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, rank string")


def test_search(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_DOCS", 7)
    draw = random.Random(2)
    texts = [C.sentence(draw, draw.randint(1, 9)) for _ in range(25)] + ["", None, "...", "nowhere", "changed", "ONE one One two", "é", "banana ba-na"] * 2
    told = []
    rows = T.top_documents(C.documents(spark), asked(spark, texts), 5, told)
    assert sorted(map(tuple, rows.collect()), key=str) == brute([r[:2] for r in C.rows()], list(enumerate(texts)), 5)
    assert told[0] > told[-1] > 0, told  # some items are proven before the last tier


def test_blocks_of_items_and_of_words(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 120)
    monkeypatch.setattr(T, "CHUNK_WORDS", 90)
    draw = random.Random(9)
    texts = [C.sentence(draw, draw.randint(1, 6)) for _ in range(9)]
    rows = T.top_documents(C.documents(spark), asked(spark, texts), 3)
    assert sorted(map(tuple, rows.collect()), key=str) == brute([r[:2] for r in C.rows()], list(enumerate(texts)), 3)


def test_query_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words here") for i in range(30)] + [(99, "other")], "doc_id long, text string")
    folder = C.write(spark, tmp_path, documents=docs, benchmark=asked(spark, ["words", None]))
    rows = T.op13_tiered_index_search(spark, folder).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(0, k + 1, k) for k in range(20)]  # ties by doc_id
    for name, d, b in (("a", C.empty(spark), asked(spark, ["x"])), ("b", docs, asked(spark, ["x"]).limit(0))):
        assert T.op13_tiered_index_search(spark, C.write(spark, tmp_path / name, documents=d, benchmark=b)).count() == 0


def test_large_rows_of_the_index_are_written_in_small_groups(spark):
    import glob

    import pyarrow.parquet as pq

    draw = random.Random(2)
    rows = [(i, " ".join(f"{draw.getrandbits(40):x}" for _ in range(300_000))) for i in range(6)]
    index = T.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 6, 1_800_000)
    files = [f for name in index.inputFiles() for f in glob.glob(name.removeprefix("file:").replace("///", "/"))]
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) == 6 and max(groups) <= 2
