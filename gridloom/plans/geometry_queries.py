"""Queries on page geometry, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from .registry import load, registry

QUERIES, ORACLE_SQL, query = registry()


def number(c: str):
    return F.col(c).cast("double")


@query("""
WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 4 AS w, CAST(p_retailprice AS DOUBLE) AS h FROM part),
b AS (SELECT *, CASE WHEN h / greatest(1, w) <= 3 THEN 1 ELSE CAST(least(3, ceil(h / greatest(1, w) / 3)) AS INTEGER) END AS n FROM t),
i AS (SELECT *, unnest(range(n)) AS i FROM b)
SELECT p_partkey, CAST(i AS INTEGER) AS band, round(CASE WHEN i > 0 THEN i * (h / n) - h / n * 0.04 ELSE 0 END, 4) AS top, round(CASE WHEN i < n - 1 THEN (i + 1) * (h / n) + h / n * 0.04 ELSE h END, 4) AS bottom FROM i
""")
def tall_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiles, four times their size wide and their price tall."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(G.tiles(number("p_size") * 4, number("p_retailprice"))).alias("band", "t"))
    return rows.select("p_partkey", "band", F.round("t.top", 4).alias("top"), F.round("t.bottom", 4).alias("bottom"))


@query("""
WITH i AS (SELECT l_orderkey, sum(greatest(0, CAST(l_quantity AS DOUBLE)) * greatest(0, CAST(l_tax AS DOUBLE) * 1000 - 20)) AS covered FROM lineitem GROUP BY l_orderkey),
s AS (SELECT o_orderkey AS section, coalesce(covered, 0) / greatest(1, 50 * (CAST(o_totalprice AS DOUBLE) / 500)) AS share FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)
SELECT section, round(share, 6) AS share, share >= 0.35 AS dominant FROM s
""")
def image_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections, their lines as images, some without an area."""
    sections = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.lit(50.0).alias("width"), (number("o_totalprice") / 500).alias("height"))
    images = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), number("l_quantity").alias("width"), (number("l_tax") * 1000 - 20).alias("height"))
    return G.image_dominance(sections, images).withColumn("share", F.round("share", 6))


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, l_partkey AS image, CAST(l_quantity AS DOUBLE) AS w FROM lineitem),
d AS (SELECT doc_id, page, image, min(CASE WHEN p_size > 5 THEN least((p_size - 5) * 4 / (w / 72), (p_size - 5) * 3 / (w * 0.5 / 72)) ELSE 0 END) AS dpi FROM p LEFT JOIN part ON p_partkey = image WHERE w > 0 GROUP BY ALL)
SELECT doc_id, CAST(page AS INTEGER) AS page, count(*) AS n_images, round(min(dpi), 4) AS least_dpi, min(dpi) >= 120 AS trusted FROM d GROUP BY doc_id, page
""")
def sharp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as placed parts, parts as images of their size, the smallest without one."""
    placed = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).cast("int").alias("page"), F.col("l_partkey").alias("image"), number("l_quantity").alias("width"), (number("l_quantity") * 0.5).alias("height"))
    sizes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), ((F.col("p_size") - 5) * 4).alias("native_width"), ((F.col("p_size") - 5) * 3).alias("native_height"))
    return G.trusted_pages(placed, sizes, ("image",)).withColumn("least_dpi", F.round("least_dpi", 4))


@query()
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as groups of a printed column for each role: no SQL, as the fold resets."""
    turns = load(spark, sf_dir, "conversations")
    return G.paginated(turns.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("column"), F.col("turn").alias("ord"), F.lit("Turn").alias("name"), F.split("text", r"\n").alias("texts")))
