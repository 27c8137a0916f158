"""The splitter of run-on cells against a plain loop, on long texts, and how often queries compute it."""

import random
import re
import time

from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.functions import text as T
from gridloom.functions import vocab as V
from gridloom.operators.normalize import split_items
from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
SPACES = "\t\n\x0b\f\r  ﻿       　"
WORDS = 'Dr. dr. e.g. E.G. (e.g. i.e. J. (J. 5. .. . a.. etc. etc.) Vs. 3a. é. Éa. noé. no. Plan board “Quote (open close) "q ; Ph.D. 10.5. m.r. U.S. x\x01y. \x01'.split(" ")


def plain(text: str) -> list[str]:
    gap = re.compile(rf'(?<=\.)[{SPACES}]+(?=[A-Z(“"])')
    out, at = [], 0
    for m in gap.finditer(text):
        token = re.split(f"[{SPACES}]", text[at : m.start()])[-1].removesuffix(".")
        bare = re.sub("[^A-Za-z.]", "", token)
        if bare and not re.fullmatch("[A-Z]", bare) and bare.lower() not in V.ABBREVIATIONS:
            out.append(text[at : m.start()].strip(SPACES))
            at = m.end()
    return [p for p in [*out, text[at:].strip(SPACES)] if p]


def test_sentences_against_a_plain_loop(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(WORDS) + draw.choice(SPACES) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cells.sentences(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_white_space(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(0x11000) if not 0xD800 <= i < 0xE000], "c string")
    found = rows.select("c", F.col("c").rlike(T.WS).alias("is"), F.col("c").rlike(f"[^{T.WS[1:-1]}]").alias("other")).where("is or not other").collect()
    assert {r["c"] for r in found} == {*SPACES, *map(chr, range(0x2001, 0x200A))} and all(r["is"] and not r["other"] for r in found)


def test_a_long_text_is_read_once(spark):
    text = "The whole board meets (and plans) every week. " * 40_000
    began = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(cells.split_cell(F.col("t")).alias("p")).first()
    assert row["p"] == ["The whole board meets (and plans) every week"] * 40_000
    assert time.time() - began < 30  # a text rebuilt at each sentence takes minutes


def test_queries_compute_the_parts_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("sentence_split", "semicolon_split"):
        found = plan(catalog.QUERIES[name](spark, SF))
        assert "Filter" not in found and "RepartitionByExpression" in found
    rows = spark.createDataFrame([("d", "inputs", "x", 0)], "doc_id string, domain string, text string, item_ord int")
    assert "size(" not in "".join(line for line in plan(split_items(rows)).splitlines() if "Filter" in line)
