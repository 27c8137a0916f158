"""Queries of what logs come to: states and saves of files, chains of moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import budget, edits, layout, sessions, sums
from ..operators.items import items
from ..streaming import checkpoints
from .model_queries import BASE, models, pick
from .registry import load, registry

QUERIES, ORACLE_SQL, query = registry()

STATUSES = tuple(V.TRANSITIONS)
LEGAL = " OR ".join(f"(f.st = '{a}' AND e.s IN ({', '.join(repr(b) for b in bs)}))" for a, bs in V.TRANSITIONS.items())
BUSY = ", ".join(map(repr, V.BUSY))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id AS k, event_id, event_id * 8000 AS t, [{", ".join(map(repr, STATUSES))}][event_id % 11 % 7 + 1] AS s, event_type AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS r, 'pending' AS st, CAST(NULL AS VARCHAR) AS saved, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS fh, CAST(NULL AS BIGINT) AS fdue, CAST(NULL AS BIGINT) AS fid,
    false AS bad, CAST(NULL AS VARCHAR) AS was FROM e
  UNION ALL SELECT k, r, CASE WHEN ok THEN s ELSE st END, now, CASE WHEN fresh THEN s || '|' || rec WHEN NOT fires THEN h END, CASE WHEN fresh THEN t + 1200000 WHEN NOT fires THEN due END, CASE WHEN fresh THEN event_id WHEN NOT fires THEN id END,
    CASE WHEN fires THEN h END, CASE WHEN fires THEN due END, CASE WHEN fires THEN id END, NOT ok, CASE WHEN NOT ok THEN st END
  FROM (SELECT *, ok AND s NOT IN ({BUSY}) AND s || '|' || rec IS DISTINCT FROM now AS fresh
    FROM (SELECT f.k, e.r, f.st, f.h, f.due, f.id, e.s, e.rec, e.t, e.event_id, coalesce(f.due <= e.t, false) AS fires, CASE WHEN f.due <= e.t THEN f.h ELSE f.saved END AS now, f.st = e.s OR {LEGAL} AS ok FROM f JOIN e ON e.k = f.k AND e.r = f.r + 1))),
o AS (SELECT k, fdue AS t, fid AS id, 'saved' AS kind, split_part(fh, '|', 1) AS s, split_part(fh, '|', 2) AS detail FROM f WHERE fid IS NOT NULL
  UNION ALL SELECT f.k, e.t, e.event_id, 'illegal', e.s, f.was FROM f JOIN e USING (k, r) WHERE f.bad
  UNION ALL SELECT k, due, id, 'saved', split_part(h, '|', 1), split_part(h, '|', 2) FROM f WHERE id IS NOT NULL AND r = (SELECT max(r) FROM e WHERE e.k = f.k))
SELECT k AS doc_id, t AS at_us, id AS event_id, kind, s AS status, detail FROM o
""")
def debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a file whose events change its state and record: what is saved when, and which changes are refused."""
    rows = load(spark, sf_dir, "events")
    status = pick(F.col("event_id") % 11, *[STATUSES[k % 7] for k in range(11)])
    log = rows.select(F.col("user_id").cast("string").alias("doc_id"), F.timestamp_micros(F.col("event_id") * 8000).alias("at"), "event_id", status.alias("status"), F.col("event_type").alias("record"))
    out = checkpoints.outcomes(log)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.unix_micros("at").alias("at_us"), "event_id", "kind", "status", "detail")


TARGET = "CASE WHEN k % 2 = 1 THEN 'impact' ELSE 'outputs' END"


@query(f"""
WITH {BASE}, w AS (SELECT *, {TARGET} AS x FROM t WHERE turn = 0),
g AS (SELECT w.k, (SELECT count(DISTINCT role) FROM t WHERE t.k = w.k AND t.domain = w.x AND t.turn <> 0) AS before FROM w),
m AS (SELECT w.*, before, substr(trim(text, ' ' || chr(10) || chr(9)), 1, 60) AS cut FROM w JOIN g USING (k))
SELECT k AS doc_id, 1 AS step, CASE WHEN domain = 'unmapped' THEN 'assign_domain' ELSE 'remap_domain' END AS action, role || '|' || cut || '|' || i AS "itemKey", CASE WHEN domain <> 'unmapped' THEN domain END AS "fromDomain", x AS "toDomain", role AS "sourceHeader" FROM m
UNION ALL SELECT k, 2, 'remap_domain', role || '|' || cut || '|0', x, 'generalOutcomes', role FROM m
UNION ALL SELECT k, 3, 'return_unmapped', role || '|' || cut || '|0', 'generalOutcomes', NULL, role FROM m
""")
def move_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turn moved three times, each time from the place that it has by then: an event a move."""
    rows = items(models(spark, sf_dir))
    k = F.col("doc_id")
    x = F.when(k % 2 == 1, "impact").otherwise("outputs")
    first = rows.where("sourcePage = 1").select(*edits.PLACE)
    rest = rows.where("sourcePage > 1").groupBy("doc_id").agg(*[F.count_distinct(F.when(F.col("domain") == d, F.col("group_name"))).cast("int").alias(d) for d in ("impact", "outputs", "generalOutcomes")])
    places = first.select("doc_id").join(rest, "doc_id", "left").fillna(0)
    to = lambda step, domain, group, goes: (domain.alias("domain"), group.alias("group_ord"), F.lit(0).alias("item_ord"), goes.alias("to_domain"), F.lit(step).alias("seq"))
    second = places.select("doc_id", *to(2, x, F.when(k % 2 == 1, F.col("impact")).otherwise(F.col("outputs")), F.lit("generalOutcomes")))
    third = places.join(first.select("doc_id", F.col("domain").alias("came")), "doc_id").select("doc_id", *to(3, F.lit("generalOutcomes"), F.col("generalOutcomes"), F.lit("unmapped")))
    log = first.select(*edits.PLACE, x.alias("to_domain"), F.lit(1).alias("seq")).unionByName(second).unionByName(third)
    _, events = edits.moved(rows, log.withColumns({"note": F.lit(None).cast("string"), "at": F.col("seq").cast("string")}))
    return events.select("doc_id", F.col("at").cast("int").alias("step"), "action", "itemKey", "fromDomain", "toDomain", "sourceHeader")


FLAT = "trim(regexp_replace(lower(regexp_replace({}, '[*_`~]', '', 'g')), '[\\s\\x0b]+', ' ', 'g'))"


@query(f"""
WITH s AS (SELECT conv_id AS k, {FLAT.format("string_agg(text, ' ' ORDER BY turn)")} AS hay FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id),
w AS (SELECT conv_id AS k, text FROM conversations WHERE regexp_matches(text, '\\S') UNION ALL SELECT DISTINCT conv_id, 'Mission ' || conv_id FROM conversations WHERE conv_id % 2 = 0)
SELECT k AS doc_id, count(*) AS n_items, count(*) FILTER (contains(coalesce(hay, ''), {FLAT.format("text")})) AS n_found FROM w LEFT JOIN s USING (k) GROUP BY k
""")
def findable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wordings of each conversation's model stand in a text that lacks every third turn."""
    turns = load(spark, sf_dir, "conversations").where("turn % 3 <> 1")
    texts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("sourceText"))
    return sessions.findable(models(spark, sf_dir), texts)


def encoded(area: str, quality: str, scale: str) -> str:
    return f"CAST(floor({area} * {quality} * {scale} * {scale} / 3) AS BIGINT)"


WAYS = ", ".join(f"({i}, {p}, CAST({q} AS DOUBLE), CAST({s} AS DOUBLE), CAST({v} AS DOUBLE))" for i, (p, q, s, v) in enumerate(budget.WAYS))


@query(f"""
WITH p AS (SELECT l_orderkey AS k, l_linenumber % 3 = 0 AS img, CAST(l_extendedprice * 40 AS DOUBLE) AS area FROM lineitem),
w(way, phase, q, s, v) AS (VALUES {WAYS}),
t AS (SELECT k, way, phase, q, s, v, sum(CASE WHEN img THEN {encoded("area", "q", "v")} ELSE {encoded("area", "q", "s")} END) AS bytes, bool_or(img) AS images, bool_or(NOT img) AS texts FROM p CROSS JOIN w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bytes <= 3800000 DESC, CASE WHEN bytes <= 3800000 THEN way ELSE -way END) AS n FROM t WHERE CASE WHEN phase = 1 THEN texts ELSE images END)
SELECT k AS doc_id, phase, q AS quality, s AS scale, v AS image_scale, CAST(bytes AS BIGINT) AS bytes, bytes <= 3800000 AS fits FROM r WHERE n = 1
""")
def budget_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their lines as pages of some area, every third an image: the first way to draw them that fits."""
    pages = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3 == 0).alias("is_image"), (F.col("l_extendedprice") * 40).cast("double").alias("area"))
    return budget.first_fit(pages, lambda q, s: F.floor(F.col("area") * q * s * s / 3))


@query()
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of each part and of all lines, summed exactly. No SQL: the engines' own sums depend on the order of rows; tests/test_sums.py
    holds the operator against an exactly rounded sum."""
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))).alias("revenue"))
    return sums.exact_sums(rows, "revenue", "l_partkey").unionByName(sums.exact_sums(rows, "revenue").withColumn("l_partkey", F.lit(None).cast(rows.schema["l_partkey"].dataType)))


@query("""
WITH w AS (SELECT conv_id AS k, turn + 1 AS page, unnest(string_split(text, ' ')) AS s, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, coalesce(sum(CAST(ends_with(s, '.') AS INT)) OVER (PARTITION BY k, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM w),
l AS (SELECT k, page, line, trim(regexp_replace(string_agg(s, ' ' ORDER BY i) FILTER (s <> ''), '[\\s\\x0b]+', ' ', 'g')) AS text, max(length(s)) AS h FROM n GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY k, page ORDER BY h) AS r, count(*) OVER (PARTITION BY k, page) AS c FROM l WHERE text <> ''),
m AS (SELECT k, page, h AS mid FROM f WHERE r = c // 2 + 1),
b AS (SELECT k, page, string_agg(CASE WHEN h >= 1.35 * mid AND length(text) <= 120 THEN '### ' ELSE '' END || text, chr(10) ORDER BY line) AS body FROM f JOIN m USING (k, page) GROUP BY ALL),
p AS (SELECT DISTINCT k, page FROM w)
SELECT k AS doc_id, trim(string_agg(chr(10) || chr(10) || '## Page ' || page || chr(10) || chr(10) || coalesce(body, ''), '' ORDER BY page), ' ' || chr(10) || chr(9)) AS text FROM p LEFT JOIN b USING (k, page) GROUP BY k
""")
def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents and turns as pages: words are runs as high as they are long, and full stops end lines."""
    turns = load(spark, sf_dir, "conversations").where("text IS NOT NULL")
    runs = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), F.posexplode(F.split("text", " ")).alias("run_no", "str"))
    return layout.page_texts(runs.withColumns({"height": F.length("str"), "eol": F.endswith("str", F.lit("."))}))
