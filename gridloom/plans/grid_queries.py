"""Queries on layout, segments, verdicts, scores and sessions, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.cells import label_of_item, split_cell
from ..functions.headers import RANKED
from ..functions.text import csv_cell
from ..operators import coverage, layout, matching, quality
from ..operators.fidelity import suggests_mismatch
from .registry import load, registry

QUERIES, ORACLE_SQL, query = registry()


@query("""
SELECT p_partkey, unnest([0, 1, 2]) AS part, unnest([p_name || ' with some more', p_brand || ' of the brand', p_type || ' as its type']) AS text FROM part
WHERE length(p_name || ' with some more; ' || p_brand || ' of the brand; ' || p_type || ' as its type') >= 60
""")
def semicolon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that list three attributes, split."""
    cell = F.concat("p_name", F.lit(" with some more; "), "p_brand", F.lit(" of the brand; "), "p_type", F.lit(" as its type"))
    parts = load(spark, sf_dir, "part").repartition("p_partkey")  # small rows, much work: dealt out however few row groups hold them
    return parts.select("p_partkey", F.posexplode(split_cell(cell)).alias("part", "text"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderstatus END AS label, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS rest FROM orders
""")
def label_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Order "), "o_orderstatus", F.lit(": "), "o_orderpriority")).otherwise(F.concat(F.lit("order "), "o_orderstatus", F.lit(" of "), "o_orderpriority"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", label_of_item(text).alias("t"))
    return rows.select("o_orderkey", "t.label", "t.rest")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each supplier and line number: the quantity that left in each week up to the last."""
    lines = load(spark, sf_dir, "lineitem").select(F.concat_ws(" ", "l_suppkey", "l_linenumber").alias("doc_id"), F.floor(F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) / 7).alias("x"), F.col("l_quantity").cast("double").alias("q"))
    weeks = lines.groupBy("doc_id", "x").agg(F.sum("q").alias("ink"))
    places = weeks.groupBy("doc_id").agg(F.max("x").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("x"))
    return places.join(weeks, ["doc_id", "x"], "left").fillna(0.0, ["ink"])


PROFILE = """
 d AS (SELECT l_suppkey || ' ' || l_linenumber AS doc_id, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 7) AS BIGINT) AS x, sum(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY ALL),
 w AS (SELECT doc_id, max(x) + 1 AS w FROM d GROUP BY doc_id), u AS (SELECT doc_id, w, unnest(range(w)) AS x FROM w),
 p AS (SELECT doc_id, w, x, coalesce(q, 0) AS ink FROM u LEFT JOIN d USING (doc_id, x)),
 l AS (SELECT doc_id, list_sort(list(ink)) AS v FROM p GROUP BY doc_id),
 m AS (SELECT doc_id, CASE WHEN v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS INTEGER) + 1] > 0 THEN v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS INTEGER) + 1] WHEN v[len(v)] > 0 THEN v[len(v)] ELSE 1 END AS level FROM l),
 i AS (SELECT doc_id, w, x, least(1.0, ink / level) AS ink FROM p JOIN m USING (doc_id))
"""


@query(f"WITH {PROFILE} SELECT doc_id, CAST(x AS INTEGER) AS x, round(ink, 6) AS ink FROM i")
def p95_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.normalized_ink(profile(spark, sf_dir)).select("doc_id", "x", F.round("ink", 6).alias("ink"))


@query(f"""
WITH {PROFILE}, g AS (SELECT doc_id, w, x, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) - 1 AS empty FROM i WHERE ink > 0.08 AND w >= 10),
s AS (SELECT *, sum(CASE WHEN empty IS NULL OR (empty > 0 AND empty >= greatest(1, floor(w * 0.012))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x) AS run FROM g),
r AS (SELECT doc_id, run, min(x) AS lo, max(x) + 1 AS hi FROM s GROUP BY doc_id, run, w HAVING max(x) + 1 - min(x) >= greatest(1, floor(w * 0.04))), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM r)
SELECT doc_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM n WHERE n BETWEEN 3 AND 9
""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bands(profile(spark, sf_dir))


@query("""
WITH m AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_quantity >= 1.35 * v[len(v) // 2 + 1] AND v[len(v) // 2 + 1] > 0 AS is_heading FROM lineitem JOIN m USING (l_orderkey)
""")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("height"))
    return layout.headings(rows).select("doc_id", "line_no", "is_heading")


@query("""
WITH g AS (SELECT conv_id AS doc_id, turn AS ord, turn + 1 + CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 1 ELSE 0 END AS s, turn + 1 AS e FROM conversations),
p AS (SELECT doc_id, max(ord) + 1 AS n FROM g GROUP BY doc_id),
k AS (SELECT *, s >= 1 AND e >= s AND e <= n AND s = coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, ord), 0) + 1 AS ok FROM g JOIN p USING (doc_id) WHERE ord < 20),
a AS (SELECT *, bool_and(coalesce(ok, false)) OVER (PARTITION BY doc_id) AND max(e) OVER (PARTITION BY doc_id) = n AS all_ok FROM k)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS end_ FROM a WHERE all_ok
UNION ALL SELECT doc_id, 1, n FROM p WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE all_ok)
""")
def interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn ranges as page groups; every third conversation has a gap and is one group."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"))
    gap = F.when((F.col("doc_id") % 3 == 0) & (F.col("ord") == 1), 1).otherwise(0)
    groups = rows.select("doc_id", "ord", (F.col("ord") + 1 + gap).cast("double").alias("start"), (F.col("ord") + 1).cast("double").alias("end_"))
    return layout.page_groups(groups, rows.groupBy("doc_id").agg((F.max("ord") + 1).alias("n")))


@query("""
WITH i AS (SELECT o_custkey AS doc_id, o_orderstatus AS domain, CASE WHEN o_custkey % 4 > 0 THEN lower(o_orderpriority) END AS fill FROM orders),
d AS (SELECT doc_id, domain, count(DISTINCT fill) AS k, count(fill) AS n FROM i GROUP BY ALL), t AS (SELECT doc_id, count(DISTINCT fill) AS n_colours FROM i GROUP BY doc_id),
s AS (SELECT doc_id, max(k) AS most, list_sort(coalesce(list(domain) FILTER (k = 1 AND n >= 3), [])) AS stamped FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_colours = 0 THEN 'none' WHEN n_colours = 1 THEN 'decorative' WHEN most >= 2 THEN 'cross_cutting' ELSE 'column_chrome' END AS kind, CAST(n_colours AS INTEGER) AS n_colours,
  CASE WHEN n_colours > 1 AND most >= 2 THEN array_to_string(stamped, ',') ELSE '' END AS stamped
FROM s JOIN t USING (doc_id)
""")
def colour_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("domain"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderpriority")).alias("fill"))
    return quality.colour_axis(rows).withColumn("stamped", F.array_join("stamped", ","))


def census_sql(items: str) -> str:
    """items: a query of doc_id, pass, signature, place and text, a row per item."""
    return f"""
WITH i AS ({items}), n AS (SELECT *, CASE WHEN regexp_matches(text, '\\S') THEN place || chr(1) || trim(regexp_replace(lower(text), '[\\s\\x0b]+', ' ', 'g')) END AS item FROM i),
r AS (SELECT doc_id, pass, count(*) AS n_items, min(signature) AS signature, coalesce(string_agg(item, chr(2) ORDER BY item), '') AS contents FROM n GROUP BY doc_id, pass),
v AS (SELECT doc_id, count(*) AS passes, min(n_items) = max(n_items) AS same_count, min(signature) IS NOT DISTINCT FROM max(signature) AS same_signature, min(contents) = max(contents) AS identical FROM r GROUP BY doc_id)
SELECT *, CASE WHEN NOT (identical OR (same_count AND same_signature)) THEN 'UNSTABLE' WHEN passes >= 3 THEN 'STABLE' ELSE 'TOO FEW PASSES' END AS verdict FROM v
"""


@query(census_sql("SELECT conv_id // 4 AS doc_id, conv_id AS pass, string_agg(role, ',' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS signature, role AS place, text FROM conversations"))
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four conversations in a row as passes over one document."""
    signature = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    turns = load(spark, sf_dir, "conversations").withColumn("group_name", F.lit(None).cast("string"))
    runs = turns.groupBy(F.floor(F.col("conv_id") / 4).alias("doc_id"), "conv_id").agg(F.count("*").alias("n_items"), signature.alias("signature"), quality.contents("role").alias("contents"))
    return quality.census(runs)


@query(census_sql("SELECT n_chars AS doc_id, doc_id AS pass, lang AS signature, 'x' AS place, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL"))
def census_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal length as passes over one, their lines as items: copies are identical, in whatever order their lines stand."""
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select("n_chars", "doc_id", "lang", F.lit("x").alias("domain"), F.lit(None).cast("string").alias("group_name"), F.explode(F.split("text", "\n")).alias("text"))
    runs = lines.groupBy("n_chars", "doc_id").agg(F.count("*").alias("n_items"), F.min("lang").alias("signature"), quality.contents().alias("contents"))
    return quality.census(runs.select(F.col("n_chars").alias("doc_id"), "n_items", "signature", "contents"))


GRID_WORDS = ("Short-Term", "outcomes", "Inputs:", "activities", "the", "Impact", "Outputs", "of", "long", "term", "medium_term", "REACH", "resources", "people", "general", "ultimate")
RANKS = ", ".join(f"('{key}', '{domain}', {rank})" for key, (rank, domain) in RANKED.items())
WORDINGS = "trim(regexp_replace(regexp_replace(lower(w), '[_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
WITH l AS (SELECT l_orderkey AS o, list([{", ".join(map(repr, GRID_WORDS))}][l_partkey % 16 + 1] ORDER BY l_linenumber, l_partkey) AS ws FROM lineitem GROUP BY l_orderkey),
w AS (SELECT DISTINCT o, {WORDINGS} AS n FROM (SELECT o, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT o, ws, unnest(range(1, len(ws) + 1)) AS i FROM l), (VALUES (1), (2), (3)) t(k))),
s(key, domain, rank) AS (VALUES {RANKS}), u AS (SELECT DISTINCT n, trim(regexp_replace(n, '[:.–—-]+$', '')) AS b FROM w),
h AS (SELECT n, arg_min(domain, rank) AS domain FROM u JOIN s ON n = key OR starts_with(n, key || ' ') OR ends_with(n, ' ' || key) OR b = key GROUP BY n)
SELECT o // 8 AS doc_id, CAST(o % 8 AS BIGINT) AS page FROM w JOIN h USING (n) GROUP BY o
HAVING count(DISTINCT domain) >= 3 AND bool_or(domain IN ({", ".join(map(repr, V.STRUCTURE))})) AND bool_or(domain IN ({", ".join(map(repr, V.RESULTS))}))
""")
def grid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages, eight a document; each line is a word, by its part: the pages on which words name three columns or more."""
    word = F.element_at(F.array(*map(F.lit, GRID_WORDS)), (F.col("l_partkey") % 16 + 1).cast("int"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", word.alias("w")).alias("x"))
    pages = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("text"))
    return coverage.grid_pages(pages.select(F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8).alias("page"), "text"))


STATUSES = ("pending", "converting", "detecting", "extracting", "editing", "completed", "error")


@query("""
WITH f AS (SELECT event_id % 7 AS s FROM events)
SELECT count(*) FILTER (s IN (4, 5)) AS ready, count(*) FILTER (s IN (1, 2, 3)) AS running, count(*) FILTER (s = 0) AS queued, count(*) FILTER (s = 6) AS attention, count(*) AS total,
  round(count(*) FILTER (s IN (4, 5, 6)) / count(*), 6) AS progress FROM f
""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 7 + 1).cast("int"))
    return quality.state_counts(load(spark, sf_dir, "events").select(status.alias("status")))


@query("""
SELECT user_id AS item_key, arg_max(event_type, (ts, event_id)) AS to_domain, max(ts) AS at, count(*) AS n FROM events GROUP BY user_id
""")
def corrections_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select(F.col("user_id").alias("item_key"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("to_domain"))
    return quality.latest_corrections(log)


@query("""
WITH s AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS u, count(DISTINCT o_orderpriority) AS sec, count(DISTINCT o_orderstatus) AS map, CASE o_custkey % 3 WHEN 0 THEN 'diagram' WHEN 1 THEN 'vertical_columns' END AS lay FROM orders GROUP BY o_custkey)
SELECT doc_id, n >= 6 AND ((n >= 8 AND u / greatest(n, 1) >= 0.3) OR (u >= 5 AND sec - map >= 2) OR (coalesce(lay, 'vertical_columns') IN ('horizontal_rows', 'diagram', 'prose_sections', 'unknown') AND u / greatest(n, 1) >= 0.15)) AS mismatch FROM s
""")
def mismatch_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = F.when(F.col("doc_id") % 3 == 0, "diagram").when(F.col("doc_id") % 3 == 1, "vertical_columns")
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("u"), F.count_distinct("o_orderpriority").alias("sec"), F.count_distinct("o_orderstatus").alias("map")
    )
    return rows.select("doc_id", suggests_mismatch(F.col("n"), F.col("u"), F.col("sec"), F.col("map"), layouts).alias("mismatch"))


@query("""
WITH c AS (SELECT l.doc_id, count(*) AS expected, count(*) FILTER (quality = 1) AS found, count(*) FILTER (quality = 1 AND toxic = 1) AS misplaced, 3 AS actual, 1 AS unmapped, 1 AS surplus FROM labels l GROUP BY l.doc_id),
t AS (SELECT sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found, sum(misplaced)::BIGINT AS misplaced, sum(actual)::BIGINT AS actual, sum(unmapped)::BIGINT AS unmapped, sum(surplus)::BIGINT AS surplus FROM c)
SELECT *, round(found / expected, 6) AS recall, round((actual - unmapped - surplus) / (actual - unmapped), 6) AS precision, round((found - misplaced) / found, 6) AS placement FROM t
""")
def score_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of pooled counts, the labels standing for the documents' counts."""
    good = F.col("quality") == 1
    counts = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("expected"), F.count_if(good).alias("found"), F.count_if(good & (F.col("toxic") == 1)).alias("misplaced"))
    fixed = {"actual": F.lit(3).cast("long"), "unmapped": F.lit(1).cast("long"), "surplus": F.lit(1).cast("long")}
    return matching.pooled(counts.withColumns(fixed))


@query("""
SELECT '"' || conv_id || '-' || role || '-' || (turn // 2) || '-' || (turn % 2) || '"' AS row_id, '"' || replace(trim(text), '"', '""') || '"' AS content FROM conversations
""")
def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids and quoted cells of an item export."""
    rows = load(spark, sf_dir, "conversations")
    row_id = F.concat_ws("-", "conv_id", "role", F.floor(F.col("turn") / 2), F.col("turn") % 2)
    return rows.select(csv_cell(row_id).alias("row_id"), csv_cell(F.trim("text")).alias("content"))


@query("""
SELECT c_custkey, n_name, count(o_orderkey) AS n_orders, count(o_orderkey) = 0 AS drop_blob FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their shared attribute attached; those that nothing refers to may go."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n_orders", F.lit(0))
    return rows.select("c_custkey", "n_name", n.alias("n_orders"), (n == 0).alias("drop_blob"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, 'Part ' || i || ' of ' || n AS split_part FROM p WHERE n > 1
""")
def segment_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a split document, numbered."""
    w = Window.partitionBy("o_custkey")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    return rows.where("n > 1").select("o_orderkey", F.format_string("Part %d of %d", "i", "n").alias("split_part"))
