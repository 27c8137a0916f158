"""Queries over documents, pages, benchmark and conversations: text functions, lines, n-grams, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.headers import column_of, synonym_of
from ..operators import coverage, diff, layout, matching, quality, restated
from .registry import load, registry

QUERIES, ORACLE_SQL, query = registry()

NORM = "trim(regexp_replace(lower({}), '[\\s\\x0b]+', ' ', 'g'))"
LINES = f"""
  SELECT doc_id, line_no, line, {NORM.format("line")} AS same FROM (
    SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
  ) WHERE regexp_matches(line, '[^\\s\\x0b]')
"""


@query(f"""
WITH l AS ({LINES}), k AS (SELECT doc_id, same, count(*) AS n FROM l GROUP BY ALL), h AS (SELECT same, min(doc_id) AS home FROM k GROUP BY same)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN home < doc_id THEN n ELSE 0 END) AS BIGINT) AS n_restated,
  CAST(sum(CASE WHEN home < doc_id THEN 0 ELSE n END) AS BIGINT) AS n_left
FROM k JOIN h USING (same) GROUP BY doc_id
""")
def restated_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restated.restated_counts(load(spark, sf_dir, "documents"))


@query(f"""
WITH l AS ({LINES}), h AS (SELECT same, min((doc_id, line_no)) AS home FROM l GROUP BY same)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, home[1] AS home_doc, CAST(home[2] AS INTEGER) AS home_line FROM l JOIN h USING (same) WHERE home[1] < doc_id
""")
def restated_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restated.restated_lines(load(spark, sf_dir, "documents"))


@query("""
SELECT substr(sha256(text), 1, 16) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def doc_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fingerprints(load(spark, sf_dir, "documents"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(same) AS key FROM l")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restated.keyed(restated.lines(load(spark, sf_dir, "documents"))).select("doc_id", "line_no", F.md5("same").alias("key"))


def turns(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Turns of every second conversation as items; conversations 2k and 2k + 1 are one document's two states."""
    rows = load(spark, sf_dir, "conversations").where(F.col("conv_id") % 2 == parity)
    return rows.select(F.floor(F.col("conv_id") / 2).alias("doc_id"), F.col("role").alias("domain"), F.when(F.col("turn") < 2, "early").otherwise("late").alias("group_name"), F.struct("turn").alias("ord"), "text")


TURNS = f"""
 SELECT conv_id // 2 AS doc_id, role AS domain, CASE WHEN turn < 2 THEN 'early' ELSE 'late' END AS group_name, turn AS ord, trim(text) AS text, {NORM.format("text")} AS same
 FROM conversations WHERE conv_id % 2 = {{}} AND regexp_matches(text, '\\S')
"""


@query(f"""
WITH b0 AS ({TURNS.format(0)}), a0 AS ({TURNS.format(1)}),
b AS (SELECT *, first_value(text) OVER (PARTITION BY doc_id, same ORDER BY ord) AS shown, row_number() OVER (PARTITION BY doc_id, same, domain, group_name ORDER BY ord DESC) AS copy FROM b0),
a AS (SELECT *, first_value(text) OVER (PARTITION BY doc_id, same ORDER BY ord) AS shown, row_number() OVER (PARTITION BY doc_id, same, domain, group_name ORDER BY ord) AS copy FROM a0),
bl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, same ORDER BY ord) AS t FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.same = b.same AND a.domain = b.domain AND a.group_name = b.group_name AND a.copy = b.copy)),
al AS (SELECT *, row_number() OVER (PARTITION BY doc_id, same ORDER BY ord) AS t FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.same = b.same AND a.domain = b.domain AND a.group_name = b.group_name AND a.copy = b.copy))
SELECT coalesce(bl.doc_id, al.doc_id) AS doc_id, CASE WHEN bl.domain IS NULL THEN 'added' WHEN al.domain IS NULL THEN 'removed' ELSE 'moved' END AS change,
  coalesce(bl.shown, al.shown) AS text, bl.domain AS from_domain, bl.group_name AS from_group, al.domain AS to_domain, al.group_name AS to_group
FROM bl FULL OUTER JOIN al ON bl.doc_id = al.doc_id AND bl.same = al.same AND bl.t = al.t
""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(turns(spark, sf_dir, 0), turns(spark, sf_dir, 1))


@query(f"""
WITH l AS (SELECT doc_id, group_name, text, count(*) AS n FROM ({TURNS.format(0)}) GROUP BY ALL), r AS (SELECT doc_id, group_name, text, count(*) AS n FROM ({TURNS.format(1)}) GROUP BY ALL)
SELECT doc_id, group_name, text, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM l FULL OUTER JOIN r USING (doc_id, group_name, text) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)
""")
def roundtrip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.count_differences(turns(spark, sf_dir, 0), turns(spark, sf_dir, 1))


TOKENS = "list_filter(string_split_regex(regexp_replace(lower(regexp_replace({}, '[*_`~]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda x: x <> '')"


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.lit(0).alias("doc_id"), F.col("item_id").alias("ord"), "text")


@query(f"""
WITH t AS (SELECT item_id, len({TOKENS.format("text")}) AS size, unnest({TOKENS.format("text")}) AS token FROM benchmark), c AS (SELECT item_id, size, token, count(*) AS n FROM t GROUP BY ALL)
SELECT x.item_id AS e, y.item_id AS a, round(2.0 * sum(least(x.n, y.n)) / (any_value(x.size) + any_value(y.size)), 6) AS score
FROM c x JOIN c y USING (token) GROUP BY x.item_id, y.item_id HAVING 2.0 * sum(least(x.n, y.n)) / (any_value(x.size) + any_value(y.size)) >= 0.2
""")
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_items(spark, sf_dir)
    return matching.similar_pairs(rows, rows, 0.2).select("e", "a", F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id // 2 AS doc_id, conv_id % 2 AS side, turn, len({TOKENS.format("text")}) AS size, unnest({TOKENS.format("text")}) AS token FROM conversations),
c AS (SELECT doc_id, side, turn, size, token, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT x.doc_id AS doc_id, x.turn AS e, y.turn AS a, 2.0 * sum(least(x.n, y.n)) / (any_value(x.size) + any_value(y.size)) AS score FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.token = y.token AND x.side = 0 AND y.side = 1
  GROUP BY x.doc_id, x.turn, y.turn HAVING 2.0 * sum(least(x.n, y.n)) / (any_value(x.size) + any_value(y.size)) >= 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, e, a) AS k FROM p),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS es, CAST([] AS BIGINT[]) AS ys, false AS taken FROM p
  UNION ALL SELECT f.doc_id, r.k, CASE WHEN list_contains(es, r.e) OR list_contains(ys, r.a) THEN es ELSE list_append(es, r.e) END, CASE WHEN list_contains(es, r.e) OR list_contains(ys, r.a) THEN ys ELSE list_append(ys, r.a) END,
    NOT (list_contains(es, r.e) OR list_contains(ys, r.a)) FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)
SELECT doc_id, e, a, round(score, 6) AS score FROM r JOIN f USING (doc_id, k) WHERE taken
""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of two conversations of a document, matched one to one."""
    number = lambda rows: rows.select("doc_id", F.col("ord.turn").alias("ord"), "text")
    found = matching.greedy_match(matching.similar_pairs(number(turns(spark, sf_dir, 0)), number(turns(spark, sf_dir, 1)), 0.2))
    return found.withColumn("score", F.round("score", 6))


@query(f"""
WITH t AS (SELECT conv_id, turn, {TOKENS.format("text")} AS ours, {NORM.format("regexp_replace(text, '[*_`~]', '', 'g')")} AS flat FROM conversations)
SELECT a.conv_id, a.turn, a.flat = '' OR contains(b.flat, a.flat) OR (length(substr(a.flat, CASE WHEN instr(a.flat, ': ') > 0 THEN instr(a.flat, ': ') + 2 ELSE 2 END)) > 8
    AND contains(b.flat, substr(a.flat, CASE WHEN instr(a.flat, ': ') > 0 THEN instr(a.flat, ': ') + 2 ELSE 2 END)))
  OR len(a.ours) = 0 OR len(list_filter(a.ours, lambda x: list_contains(b.ours, x))) >= 0.9 * len(a.ours) AS found
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
""")
def source_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn's wording stands in the turn before it."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", T.in_source("text", "source").alias("found"))


@query("""
WITH p AS (SELECT conv_id, turn, role, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS flat FROM conversations),
g AS (SELECT conv_id, turn, role, unnest(list_distinct(list_transform(range(1, greatest(length(flat) - 10, 1)), lambda i: substr(flat, i, 12)))) AS gram FROM p WHERE length(flat) >= 12),
own AS (SELECT conv_id, gram, min(turn) AS turn FROM g GROUP BY ALL HAVING count(*) = 1)
SELECT conv_id AS doc_id, turn AS page, count(*) AS n_own FROM own GROUP BY ALL
""")
def ngram_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-character runs that one turn alone of its conversation has."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), T.char_grams("text").alias("grams"))
    return coverage.own_grams(rows).groupBy("doc_id", "page").agg(F.count("*").alias("n_own"))


@query(f"""
WITH l AS ({LINES}), m AS (SELECT *, CASE WHEN length(same) <= 40 THEN line_no END AS mark FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS INTEGER) AS page FROM m
""")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last short line before it, its section's mark."""
    rows = restated.keyed(restated.lines(load(spark, sf_dir, "documents")))
    return layout.carried(rows, F.when(F.length("same") <= 40, F.col("line_no"))).select("doc_id", "line_no", "page")


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-on turns as their parts."""
    from ..functions.cells import split_cell

    parts = F.coalesce(split_cell(F.col("text")), F.array("text"))  # exploded as it is: a column of its own would be computed for a filter too
    rows = load(spark, sf_dir, "conversations").repartition("conv_id", "turn")  # small rows, much work: dealt out however few row groups hold them
    return rows.select("conv_id", "turn", F.posexplode(parts).alias("part", "text"))


@query("""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS bare FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(replace(bare, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS text FROM t)
SELECT page_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n_chars FROM d
""")
def html_text_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.squeeze(T.decode_entities(F.regexp_replace("html", "<[^>]*>", " ")))
    rows = load(spark, sf_dir, "pages").select("page_id", text.alias("text"))
    return rows.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("""
WITH t AS (SELECT doc_id, text || '![x](data:image/png;base64,' || repeat('QUJD', 20) || ') tail' AS t FROM documents)
SELECT doc_id, length(t) - length(trim(regexp_replace(regexp_replace(regexp_replace(t, '!\\[[^\\]]*\\]\\(\\s*data:[^)]*\\)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), chr(10) || chr(9) || chr(13) || ' ')) AS n_binary FROM t
""")
def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that binary payloads cost, each document being given one."""
    payload = F.concat("text", F.lit("![x](data:image/png;base64," + "QUJD" * 20 + ") tail"))
    return load(spark, sf_dir, "documents").select("doc_id", T.binary_chars(payload).cast("long").alias("n_binary"))


@query("""
WITH h AS (SELECT doc_id, sha256(coalesce(CASE WHEN source <> '' THEN source END || chr(0), '') || text) AS h FROM documents WHERE text <> '')
SELECT doc_id, CAST(CASE WHEN n > 2147483647 THEN n - 4294967296 ELSE n END AS INTEGER) AS seed FROM (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS n FROM h)
""")
def content_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.seed("source", "text").alias("seed"))


HEADERS = """
WITH p AS (SELECT p_partkey, p_size, CASE p_size % 8 WHEN 0 THEN 'Short-Term Outcomes' WHEN 1 THEN 'program_activities:' WHEN 2 THEN 'Resources & ' || lower(p_type) WHEN 3 THEN 'Products' WHEN 4 THEN 'reach ' || lower(p_name) WHEN 5 THEN 'OUTCOMES --' WHEN 6 THEN 'Impact' ELSE p_name END AS header FROM part)
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'shortTermOutcomes' WHEN 1 THEN NULL WHEN 3 THEN 'outputs' WHEN 4 THEN 'outputs' WHEN 5 THEN 'generalOutcomes' WHEN 6 THEN 'impact' WHEN 2 THEN 'inputs' END AS loose,
  CASE p_size % 8 WHEN 0 THEN 'shortTermOutcomes' WHEN 3 THEN 'outputs' WHEN 5 THEN 'generalOutcomes' WHEN 6 THEN 'impact' END AS strict
FROM p
"""


@query(HEADERS)
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, made of all parts' attributes, to columns: loose and strict."""
    return looked_up(load(spark, sf_dir, "part"))


@query(HEADERS)
def header_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as header_lookup, under the name of the round in which that left parts out."""
    return looked_up(load(spark, sf_dir, "part"))


def looked_up(parts: DataFrame) -> DataFrame:
    m = F.col("p_size") % 8
    header = (
        F.when(m == 0, "Short-Term Outcomes").when(m == 1, "program_activities:").when(m == 2, F.concat(F.lit("Resources & "), F.lower("p_type"))).when(m == 3, "Products")
        .when(m == 4, F.concat(F.lit("reach "), F.lower("p_name"))).when(m == 5, "OUTCOMES --").when(m == 6, "Impact").otherwise(F.col("p_name"))
    )
    rows = parts.select("p_partkey", header.alias("h"))
    rows = rows.withColumns({"header": T.norm_header("h"), "bare": T.bare_header("h")})
    return rows.select("p_partkey", synonym_of("header", "bare").alias("loose"), column_of("bare").alias("strict"))
