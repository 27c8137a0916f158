"""Header lookups over every part, underscores and plain names among them."""

import re

import duckdb

from gridloom.functions import vocab as V
from gridloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
PARTS = [
    (1, 8, "azure", "TIN"), (2, 1, "azure", "TIN"), (3, 2, "azure", "TIN"), (4, 3, "azure", "TIN"), (5, 4, "azure", "TIN"), (6, 5, "azure", "TIN"), (7, 6, "azure", "TIN"),
    (8, 7, "azure", "TIN"), (9, 7, "Program_Activities", "TIN"), (10, 7, "activities:", "TIN"), (11, 7, "long_term", "TIN"), (12, 7, "impacts", "TIN"), (13, 7, "Ultimate  Impact -", "TIN"),
    (14, 7, "broad reach", "TIN"), (15, 7, "reached", "TIN"), (16, 7, "", "TIN"), (17, 7, "Inputs/Enablers", "TIN"), (18, 15, "outcomes short term", "TIN"),
]


def looked_up(key, size, name, kind):
    h = ["Short-Term Outcomes", "program_activities:", "Resources & " + kind.lower(), "Products", "reach " + name.lower(), "OUTCOMES --", "Impact", name][size % 8]
    n = " ".join(re.sub("[_/]+", " ", h.lower()).split())
    b = re.sub("[:.\\-–—]+$", "", n).strip()
    hits = [(len(k), d) for k, d in V.SYNONYMS if n == k or n.startswith(k + " ") or n.endswith(" " + k) or b == k]
    return key, max(hits)[1] if hits else None, dict(V.SYNONYMS).get(b)


def test_every_header(spark, tmp_path):
    spark.createDataFrame(PARTS, "p_partkey long, p_size int, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.QUERIES["header_lookup_all"](spark, str(tmp_path)).collect()
    want = [looked_up(*p) for p in PARTS]
    assert sorted(map(tuple, found)) == want
    assert want[1] == (2, None, None) and want[7] == (8, None, None) and want[8] == (9, "activities", None) and want[9] == (10, "activities", "activities")


def test_every_part_by_the_case_of_the_sql(spark):
    sql = catalog.ORACLE_SQL["header_lookup"]
    assert "WHERE" not in sql and sql == catalog.ORACLE_SQL["header_lookup_all"]
    want = duckdb.sql(sql.replace("FROM part", f"FROM '{SMALL}/part.parquet'")).fetchall()
    found = catalog.QUERIES["header_lookup_all"](spark, SMALL).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and len(found) == spark.read.parquet(f"{SMALL}/part.parquet").count()
