"""Headers against a plain search of all keys; identical passes in any order."""

import itertools

from gridloom.functions import vocab as V
from gridloom.functions.headers import synonym_domain
from gridloom.operators import coverage, quality
from pyspark.sql import functions as F


def plain(label):
    n = " ".join(label.lower().replace("_", " ").replace("/", " ").split())
    for key, domain in sorted(V.SYNONYMS, key=lambda s: -len(s[0])):
        if n == key or n.startswith(key + " ") or n.endswith(" " + key) or n.rstrip(":.-–—").strip() == key:
            return domain
    return None


def test_synonyms(spark):
    words = ["Short", "term", "short-term", "outcomes", "Impact", "inputs:", "products", "the", "", "reach —", "ultimate_impact", "general"]
    labels = [" ".join(w) for n in (1, 2, 3) for w in itertools.product(words, repeat=n)]
    found = spark.createDataFrame([(x,) for x in labels], "h string").select("h", synonym_domain("h").alias("d")).collect()
    assert [(r["h"], r["d"]) for r in found if r["d"] != plain(r["h"])] == []
    assert plain("impact inputs") == "impact" and spark.range(1).select(synonym_domain(F.lit(None).cast("string"))).first()[0] is None


def test_grid_pages(spark):
    rows = [(1, 1, "Inputs Activities\nshort-term outcomes"), (1, 2, "inputs outputs activities"), (1, 3, ""), (1, 4, None), (2, 1, "Reach impact resources impact")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id int, page int, text string")
    assert sorted(map(tuple, coverage.grid_pages(df).collect())) == [(1, 1), (2, 1)]
    assert coverage.grid_pages(df.where("false")).count() == 0


def test_identical_passes(spark):
    passes = {("d", 0): ["a", "b", "b"], ("d", 1): [" B", "a", "b"], ("d", 2): ["b", "a", "b ", " "], ("e", 0): ["a", "b"], ("e", 1): ["a", "b", "b"], ("f", 0): ["ab"], ("f", 1): ["ba"], ("f", 2): ["ab"], ("g", 0): [None]}
    rows = [(d, p, "inputs", None if i % 2 else "General", t) for (d, p), texts in passes.items() for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "doc_id string, pass int, domain string, group_name string, text string")
    runs = items.groupBy("doc_id", "pass").agg(F.count_if(F.trim("text") != "").alias("n_items"), F.when(F.col("doc_id") == "d", F.col("pass").cast("string")).otherwise("s").alias("signature"), quality.contents().alias("contents"))
    found = {r["doc_id"]: (r["passes"], r["same_count"], r["same_signature"], r["identical"], r["verdict"]) for r in quality.census(runs).collect()}
    assert found == {"d": (3, True, False, True, "STABLE"), "e": (2, False, True, False, "UNSTABLE"), "f": (3, True, True, False, "STABLE"), "g": (1, True, True, True, "TOO FEW PASSES")}
