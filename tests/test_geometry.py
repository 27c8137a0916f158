"""Page geometry on small inputs, and printed pages against a plain loop."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_placements(spark):
    ops = [
        ("restore", None, None), ("save", None, None), ("transform", [2.0, 0.0, 0.0, 3.0, 5.0, 5.0], None), ("paint", None, "i"), ("transform", [0.0, 10.0, -10.0, 0.0, 0.0, 0.0], None),
        ("paint", None, "i"), ("transform", [1.0], None), ("save", None, None), ("transform", [0.5, 0.0, 0.0, 0.5, 0.0, 0.0], None), ("paint", None, "j"), ("paint", None, None), ("restore", None, None), ("restore", None, None), ("fill", None, None), ("paint", None, "k"),
    ]
    rows = [("d", 1, i, *op) for i, op in enumerate(ops)] + [("e", 1, 0, "save", None, None)]
    placed = G.placements(spark.createDataFrame(rows, "doc_id string, page int, ord int, op string, matrix array<double>, image string").repartition(3)).collect()
    assert [tuple(r) for r in sorted(placed)] == [("d", 1, 0, "i", 2.0, 3.0), ("d", 1, 1, "i", 30.0, 20.0), ("d", 1, 2, "j", 15.0, 10.0), ("d", 1, 3, "k", 1.0, 1.0)]


def test_trusted_pages(spark):
    placed = spark.createDataFrame([("d", 1, "i", 72.0, 72.0), ("d", 1, "i", 144.0, 72.0), ("d", 2, "j", 72.0, 36.0), ("d", 2, "k", 0.0, 9.0), ("d", 3, "k", 9.0, 9.0)], "doc_id string, page int, image string, width double, height double")
    sizes = spark.createDataFrame([("d", "i", 200, 900), ("d", "j", 120, 60), ("d", "k", None, 5)], "doc_id string, image string, native_width int, native_height int")
    assert sorted(map(tuple, G.trusted_pages(placed, sizes).collect())) == [("d", 1, 1, 100.0, False), ("d", 2, 1, 120.0, True), ("d", 3, 1, 0.0, False)]


def test_tiles_and_dominance(spark):
    sizes = spark.createDataFrame([(10.0, 30.0), (10.0, 60.0), (0.0, 100.0)], "w double, h double")
    cut = [[tuple(t) for t in r[0]] for r in sizes.select(G.tiles(F.col("w"), F.col("h"))).collect()]
    assert cut[0] == [(0.0, 30.0)] and [tuple(round(x, 6) for x in t) for t in cut[1]] == [(0.0, 31.2), (28.8, 60.0)] and len(cut[2]) == 3
    sections = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 0.0, 0.0)], "section int, width double, height double")
    images = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 2.0), (1, -9.0, -9.0), (2, 3.0, 3.0)], "section int, width double, height double")
    assert sorted(map(tuple, G.image_dominance(sections, images).collect())) == [(1, 0.35, True), (2, 0.09, False), (3, 0.0, False)]


def test_column_fractions(spark):
    """Three columns of 20 with gutters of 20 between them, from place 10 on; the gate on width, aspect and box."""
    ink = [(d, x, 1.0 if x >= 10 and (x - 10) % 40 < 20 else 0.0) for d in "abcd" for x in range(120)]
    boxes = [("a", 10, 110, 0, 100, True), ("b", 10, 110, 0, 100, False), ("c", 10, 50, 0, 10, True), ("d", None, None, None, None, True)]
    found = G.column_fractions(spark.createDataFrame(ink, "doc_id string, x int, ink double"), spark.createDataFrame(boxes, "doc_id string, x0 int, x1 int, y0 int, y1 int, dominant boolean"))
    assert sorted(map(tuple, found.collect())) == [("a", 0.0, 0.2), ("a", 0.4, 0.6), ("a", 0.8, 1.0)]


def pages(groups):
    """(doc_id, column, ord, page) of groups (doc_id, column, ord, name, texts)."""
    out, columns = [], defaultdict(list)
    for g in sorted(groups, key=lambda g: g[:3]):
        columns[g[:2]].append(g)
    for key, rows in columns.items():
        page = filled = 0
        for _, _, ord_, name, texts in rows:
            px = 10 if name == "General" else 32
            px += 12 + sum(18 * max(1, math.ceil(len((t or "").encode("utf-16-be")) / 2 / 35)) for t in texts) if texts else 0
            if filled and filled + px > (800 if page else 600):
                page, filled = page + 1, 0
            filled += px
            out.append((*key, ord_, page))
    return sorted(out)


def test_printed_pages(spark):
    groups = [("d", c, i, "General" if i % 3 else "G", ["x" * (i * 7 * k % 400) for k in range(i % 6)] + [None] * (i % 2) + ["😀" * 30] * (i % 4 == 1)) for c in ("p", "q") for i in range(40 if c == "p" else 9)] + [("e", "p", 0, None, ["y" * 99999])]
    found = G.paginated(spark.createDataFrame(groups, "doc_id string, column string, ord int, name string, texts array<string>").repartition(4)).collect()
    assert sorted(map(tuple, found)) == pages(groups) and max(r["page"] for r in found) > 2
    assert G.paginated(spark.createDataFrame([], "doc_id string, column string, ord int, name string, texts array<string>")).count() == 0


def test_printed_pages_query(spark):
    turns = [(r["conv_id"], r["role"], r["turn"], "Turn", [] if r["text"] is None else r["text"].split("\n")) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    assert sorted(tuple(r) for r in catalog.QUERIES["printed_pages"](spark, SMALL).collect()) == pages(turns)
