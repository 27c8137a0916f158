"""Queries over models made of the driver's tables: exports, rules, slices, sheets, edits, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, vocab as V
from ..operators import edits, exports, rules, sessions, slicing
from ..operators.items import items, nest
from ..operators.normalize import normalize
from ..sources import sheets
from ..sources.schema import MODEL
from .registry import load, registry

QUERIES, ORACLE_SQL, query = registry()


def pick(number, *values):
    """The value that a number selects, from 0; null values stay null."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per conversation: its turns are items, dealt over the nine domains, grouped by role."""
    rows = load(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id"))
    rows = rows.select(
        "doc_id", pick(F.col("turn") + F.col("doc_id"), *V.GROUPED).alias("domain"), pick(F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2), 0, 1, 2).alias("group_ord"),
        F.col("role").alias("group_name"), F.col("turn").alias("item_ord"), "text", (F.col("turn") % 5 != 4).alias("verbatim"), pick(F.col("turn"), "Red ", " blue", None).alias("fillColor"),
        F.when(F.col("turn") % 2 == 1, "Black").alias("borderColor"), (F.col("turn") + 1).cast("int").alias("sourcePage"),
    )
    k = F.col("doc_id")
    boxed = lambda c: F.struct(c.alias("content"))
    known = {
        "organization": F.concat(F.lit("Org "), (k % 7).cast("string")), "program": F.concat(F.lit("Program "), k.cast("string")), "impactStatement": boxed(F.lit(None).cast("string")),
        "mission": boxed(F.when(k % 2 == 0, F.concat(F.lit("Mission "), k.cast("string")))), "targetPopulation": boxed(F.lit(" ")), "colorLegend": F.when(k % 3 == 0, " key "),
        "extractionStatus": pick(k, "ok", "partial", "abstained"), "extractionConfidence": pick(k, "high", "medium", "low", None),
        "extractionBlockers": F.when(k % 5 == 0, F.array(F.lit("first"), F.lit("second"))), "documentTypeAssessment": pick(k, "logic_model", "not_logic_model", "unclear", None),
    }
    out = nest(rows).withColumns(known)
    return out.select("doc_id", *[F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MODEL.fields])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation, in one of four states."""
    k = F.col("doc_id")
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return rows.select(
        "doc_id", F.concat(F.lit("conv"), k.cast("string"), pick(k, ".pdf", ".DOCX", ".xlsx")).alias("file_name"), pick(k, "completed", "editing", "error", "extracting").alias("status"),
        F.when(k % 6 == 0, "Part 1 of 2").alias("split_part_label"), F.when(k % 2 == 1, F.concat(F.lit("h"), k.cast("string"))).alias("document_hash"), F.when(k % 4 == 2, "too large").alias("error"),
        F.when(k % 8 == 2, F.array(F.lit("hard to read"))).otherwise(F.expr("cast(array() as array<string>)")).alias("blockers"),
    )


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NAMES = "[" + ", ".join(map(text_of, V.GROUPED)) + "]"
CASE_LABELS = "CASE domain " + " ".join(f"WHEN '{d}' THEN {text_of(label)}" for d, label in V.LABELS.items()) + " END"
FLAG = (
    "CASE WHEN k % 4 = 1 AND grid > 0 THEN {} WHEN k % 4 = 1 THEN {} WHEN k % 4 = 2 AND grid > 0 THEN {} WHEN k % 4 = 2 THEN {} ELSE '' END"
).format(*[text_of(V.TYPE_FLAGS[x]) for x in (("not_logic_model", True), ("not_logic_model", False), ("unclear", True), ("unclear", False))])
#: The models and files above: t the items with their places, d the documents.
BASE = f"""
t0 AS (SELECT conv_id AS k, turn, role, text, {NAMES}[(turn + conv_id) % 9 + 1] AS domain FROM conversations),
t AS (SELECT *, dense_rank() OVER (PARTITION BY k, domain ORDER BY role) - 1 AS g, row_number() OVER (PARTITION BY k, domain, role ORDER BY turn) - 1 AS i, list_position({NAMES}, domain) + 2 AS dord FROM t0),
d AS (SELECT k, count(*) AS total, count(*) FILTER (domain = 'unmapped') AS loose, count(*) FILTER (domain <> 'unmapped') AS grid FROM t GROUP BY k),
a AS (SELECT *, 'Org ' || k % 7 AS organization, 'Program ' || k AS program, CASE WHEN k % 3 = 0 THEN 'key' ELSE '' END AS color_legend, ['ok', 'partial', 'abstained'][k % 3 + 1] AS extraction_status,
  coalesce(['high', 'medium', 'low', NULL][k % 4 + 1], '') AS extraction_confidence, CASE WHEN k % 5 = 0 THEN 'first | second' ELSE '' END AS extraction_blockers,
  'conv' || k || ['.pdf', '.DOCX', '.xlsx'][k % 3 + 1] || CASE WHEN k % 6 = 0 THEN ' — Part 1 of 2' ELSE '' END AS source_filename, CASE WHEN k % 2 = 1 THEN 'h' || k ELSE '' END AS document_hash,
  ['completed', 'editing', 'error', 'extracting'][k % 4 + 1] AS status,
  CASE WHEN (k % 3 = 1 OR k % 4 = 1) AND NOT (k % 3 = 2 OR k % 4 = 2) THEN 'Needs Review' ELSE 'Successfully Processed' END AS qa_status, {FLAG} AS document_type_flag FROM d)
"""
ITEM_CELLS = """trim(text, ' ' || chr(10) || chr(9)) AS content, coalesce(['Red', 'blue', ''][turn % 3 + 1], '') AS fill_color, CASE WHEN turn % 2 = 1 THEN 'Black' ELSE '' END AS border_color,
  role AS source_header, CAST(turn + 1 AS VARCHAR) AS source_page, CASE WHEN turn % 5 = 4 THEN 'Yes' ELSE '' END AS needs_review"""
SHARED = "organization, program, color_legend, extraction_status, extraction_confidence, extraction_blockers, '' AS mapping_corrections_json, source_filename, document_hash, qa_status, document_type_flag"


@query(f"""
WITH {BASE},
r AS (SELECT k, dord, g, i, k || '-' || domain || '-' || g || '-' || i AS row_id, {CASE_LABELS} AS domain_label, role AS group_name, {ITEM_CELLS} FROM t
  UNION ALL SELECT k, 1, NULL, NULL, k || '-mission', 'Mission / Overview', 'General', 'Mission ' || k, '', '', '', '', '' FROM d WHERE k % 2 = 0)
SELECT k AS doc_id, CAST(dord AS INTEGER) AS domain_ord, CAST(g AS INTEGER) AS group_ord, CAST(i AS INTEGER) AS item_ord, row_id, domain_label, group_name, content, fill_color, border_color, source_header, source_page, needs_review,
  '' AS source_note, '' AS mapped_by, '' AS mapping_confidence, '' AS mapping_note, {SHARED} FROM r JOIN a USING (k)
""")
def export_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item-level export of all models."""
    return exports.full_rows(models(spark, sf_dir), files(spark, sf_dir))


@query(f"""
WITH {BASE}
SELECT k AS doc_id, CAST(dord AS INTEGER) AS domain_ord, CAST(g AS INTEGER) AS group_ord, CAST(i AS INTEGER) AS item_ord, k || '-' || domain || '-' || g || '-' || i AS row_id, organization, program, role AS "group", {CASE_LABELS} AS domain,
  trim(text, ' ' || chr(10) || chr(9)) AS outcome_text, concat_ws(' ', nullif(['Red', 'blue', ''][turn % 3 + 1], ''), CASE WHEN turn % 2 = 1 THEN 'border:Black' END) AS color_coding,
  CASE WHEN turn % 5 = 4 THEN 'Yes' ELSE '' END AS needs_review, color_legend, source_filename, qa_status, document_type_flag, 'logic_model' AS source_type, document_hash
FROM t JOIN a USING (k) WHERE dord BETWEEN 6 AND 9 AND status IN ('completed', 'editing')
""")
def export_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome items of finished documents."""
    return exports.coding_rows(models(spark, sf_dir), files(spark, sf_dir))


@query(f"""
WITH {BASE}
SELECT k AS doc_id, source_filename, document_hash, status AS pipeline_status, '' AS prompt_version, '' AS prompt_variant, '' AS model_id, '' AS served_model_id, organization, program, qa_status, extraction_status, extraction_confidence,
  extraction_blockers, document_type_flag, '' AS layout_family, CAST(total AS VARCHAR) AS total_items, CAST(loose AS VARCHAR) AS unmapped_items, '0' AS mapping_corrections_count, '0' AS possibly_missed_regions_count,
  CASE WHEN k % 6 = 0 THEN 'Part 1 of 2' ELSE '' END AS split_part_label, CASE WHEN k % 4 = 2 THEN 'too large' ELSE '' END AS error_message, CASE WHEN k % 3 = 1 THEN 'docx' ELSE 'pdf' END AS source_format, '' AS warnings, '' AS pages_processed,
  '' AS mapping_corrections_json, '' AS possibly_missed_regions_json
FROM (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN 'first | second' WHEN k % 8 = 2 THEN 'hard to read' ELSE '' END AS extraction_blockers) FROM a) WHERE status IN ('completed', 'editing', 'error')
""")
def export_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document-level log of finished and failed files."""
    return exports.log_rows(models(spark, sf_dir), files(spark, sf_dir))


@query(f"""
WITH {BASE},
r AS (SELECT k, domain, role AS group_name, text FROM t UNION ALL SELECT k, 'mission', 'General', 'Mission ' || k FROM d WHERE k % 2 = 0)
SELECT source_filename AS key, domain, group_name, count(*) AS n, min(trim(text, ' ' || chr(10) || chr(9))) AS first_text FROM r JOIN a USING (k) GROUP BY ALL
""")
def export_renested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported rows, brought back to the groups of their documents by file name."""
    back = exports.reconstituted(exports.full_rows(models(spark, sf_dir), files(spark, sf_dir)))
    return back.groupBy("key", "domain", "group_name").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query()
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the export loses or adds: nothing. Tampered exports are in tests/test_models.py."""
    return exports.roundtrip(models(spark, sf_dir), files(spark, sf_dir))


NORM = "trim(regexp_replace(lower({}), '[\\s\\x0b]+', ' ', 'g'))"


@query(f"""
WITH {BASE}, w AS (SELECT k, domain, {NORM.format("text")} AS same FROM t WHERE domain <> 'unmapped' UNION ALL SELECT k, 'mission', 'mission ' || k FROM d WHERE k % 2 = 0),
e AS (SELECT conv_id AS k, substr(text, 1, 25) AS needle, {NORM.format("substr(text, 1, 25)")} AS n FROM conversations WHERE turn = 0)
SELECT k AS doc_id, 'missing' AS rule, 'inputs' AS domain, needle AS detail FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.k = e.k AND domain = 'inputs' AND contains(same, n))
UNION ALL SELECT DISTINCT e.k, 'forbidden', domain, needle FROM e JOIN w ON w.k = e.k AND domain IN ('outputs', 'impact', 'mission') AND contains(same, n)
UNION ALL SELECT DISTINCT e.k, 'fabricated', domain, needle FROM e JOIN w ON w.k = e.k AND contains(same, n)
UNION ALL SELECT k, 'empty', x, '' FROM d CROSS JOIN (VALUES ('activities'), ('mission'), ('unmapped')) v(x) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.k = d.k AND w.domain = x) AND NOT (x = 'unmapped' AND loose > 0)
UNION ALL SELECT k, 'general_only', domain, string_agg(DISTINCT role, ', ' ORDER BY role) FROM t WHERE domain = 'activities' GROUP BY ALL
UNION ALL SELECT k, 'group', 'activities', 'SYSTEM role' FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = d.k AND domain = 'activities' AND role = 'system')
UNION ALL SELECT k, 'statement_absent', 'impactStatement', '' FROM d
""")
def placement_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of rules that each conversation's first words make."""
    all_ = models(spark, sf_dir)
    first = load(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.substring("text", 1, 25).alias("needle"))
    placed = first.select("doc_id", F.lit("inputs").alias("domain"), F.lit(None).cast("string").alias("group_name"), "needle", F.array(*map(F.lit, ("outputs", "impact", "mission"))).alias("forbidden"))
    ids = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    statement = ids.select("doc_id", F.lit(True).alias("required"), F.array(F.lit("children")).alias("contains"), F.array(F.lit("mission")).alias("must_not_be_in"), F.lit("mission").alias("not_duplicate"))
    found = rules.fixture_breaches(
        all_, placed, ids.select("doc_id", F.lit("activities").alias("domain"), F.lit("SYSTEM role").alias("group_name")), first, ids.select("doc_id", F.lit("activities").alias("domain")), statement,
        ids.select("doc_id", F.explode(F.array(*map(F.lit, ("activities", "mission", "unmapped")))).alias("domain")),
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per part: its brand as a group, with its name, and attributes labelled by brand and by name."""
    texts = F.array("p_name", F.concat("p_brand", F.lit(": "), "p_type"), F.concat("p_name", F.lit(" - size "), F.col("p_size").cast("string")), F.concat(F.lit("No "), "p_brand"), F.concat("p_name", F.lit(" — "), "p_type"))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), pick(F.col("p_size"), *V.GROUPED).alias("domain"), F.lit(0).alias("group_ord"), F.col("p_brand").alias("group_name"), F.posexplode(texts).alias("item_ord", "text"))
    out = nest(rows)
    return out.select("doc_id", *[F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MODEL.fields])


FIELD_LABEL = "CASE p_size % 9 " + " ".join(f"WHEN {i} THEN {text_of(V.FIELD_LABELS[d])}" for i, d in enumerate(V.GROUPED)) + " END"


@query(f"""
SELECT p_partkey AS doc_id, 'group_name_repeated_in_item' AS kind, {FIELD_LABEL} AS domain, p_brand AS group_name, p_brand || ': ' || p_type AS text, NULL AS example FROM part
UNION ALL SELECT p_partkey, 'parent_label_as_item', {FIELD_LABEL}, p_brand, p_name, p_name || ' - size ' || p_size FROM part
""")
def nesting_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that repeat their group, and items that are another's label."""
    return rules.nesting_breaches(part_models(spark, sf_dir))


@query("""
WITH b AS (SELECT conv_id, turn + 1 AS page, text FROM conversations), n AS (SELECT conv_id, max(page) AS n FROM b GROUP BY conv_id)
SELECT conv_id AS doc_id, 2 AS start, 3 AS end_, coalesce(trim(string_agg('## Page ' || (page - 1) || chr(10) || text, chr(10) ORDER BY page) FILTER (page BETWEEN 2 AND 3), ' ' || chr(10) || chr(9)), '') AS "textTrack",
  coalesce(string_agg('i' || page, ',' ORDER BY page) FILTER (page BETWEEN 2 AND 3), '') AS images, coalesce(string_agg(CAST(page - 1 AS VARCHAR), ',' ORDER BY page) FILTER (page BETWEEN 2 AND 3), '') AS pages,
  coalesce(string_agg('Page ' || (page - 1) || ' of this document', ',' ORDER BY page) FILTER (page BETWEEN 2 AND 3) || ',', '') || 'general note' AS warnings
FROM b JOIN n USING (conv_id) GROUP BY conv_id
""")
def bundle_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 and 3 of each conversation, a turn being a page."""
    page = F.struct((F.col("turn") + 1).alias("page"), "text")
    rows = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(page)).alias("p"))
    number = lambda x: x["page"].cast("string")
    bundles = rows.select(
        "doc_id", F.transform("p", lambda x: F.concat(F.lit("i"), number(x))).alias("images"), F.transform("p", lambda x: F.struct(x["page"].cast("int").alias("page"), F.lit(None).cast("int").alias("column"))).alias("imageRefs"),
        F.transform("p", number).alias("previewImages"), F.array_join(F.transform("p", lambda x: F.concat(F.lit("## Page "), number(x), F.lit("\n"), x["text"])), "\n").alias("textTrack"),
        F.concat(F.transform("p", lambda x: F.concat(F.lit("Page "), number(x), F.lit(" of this document"))), F.array(F.lit("general note"))).alias("warnings"), F.lit("pdf").alias("sourceFormat"),
    )
    cut = slicing.sliced(slicing.assembled(bundles), rows.select("doc_id", F.lit(2).alias("start"), F.lit(3).alias("end_")))
    pages = F.array_join(F.transform("imageRefs", lambda r: r["page"].cast("string")), ",")
    return cut.select("doc_id", "start", "end_", "textTrack", F.array_join("images", ",").alias("images"), pages.alias("pages"), F.array_join("warnings", ",").alias("warnings"))


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT k AS doc_id, '## Sheet: Orders & co' || chr(10) || chr(10) || '| key |  | priority | open |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || o_orderkey || ' |  | ' || p || ' — of <' || s || '> \\| | ' || CASE s WHEN 'O' THEN 'TRUE' ELSE 'FALSE' END || ' |', chr(10) ORDER BY r) AS "textTrack" FROM o GROUP BY k
""")
def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks made of each customer's orders, with shared strings, gaps and line breaks, as Markdown tables."""
    cell = F.concat(
        F.lit('<row><c r="A9"><v>'), F.col("o_orderkey").cast("string"), F.lit('</v></c><c r="C9" t="inlineStr"><is><t>'), "o_orderpriority", F.lit(" \n of &lt;"), "o_orderstatus",
        F.lit('&gt; |</t></is></c><c t="b"><v>'), F.when(F.col("o_orderstatus") == "O", "1").otherwise("0"), F.lit("</v></c></row><row/>"),
    )
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("xml")))).alias("rows"))
    head = '<sheetData><row/><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c t="inlineStr"><is><t>op</t><t xml:space="preserve">en</t></is></c><c r="H1"><v> </v></c></row>'
    sheet = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["xml"]), ""), F.lit("</sheetData>"))
    named = lambda part, xml: F.struct(F.lit(part).alias("part"), xml.alias("xml"))
    strings = F.lit('<sst><si><t>key</t></si><si><t>unused</t></si><si><r><t>prio</t></r><r><t>rity</t></r></si></sst>')
    workbook = F.lit('<workbook><sheets><sheet name="Orders &amp; co" sheetId="1"/><sheet name="Blank" sheetId="2"/></sheets></workbook>')
    parts = rows.select("doc_id", F.explode(F.array(named("xl/worksheets/sheet1.xml", sheet), named("xl/worksheets/sheet2.xml", F.lit("<sheetData><row/></sheetData>")), named("xl/sharedStrings.xml", strings), named("xl/workbook.xml", workbook))).alias("p")).select("doc_id", "p.*")
    return sheets.workbook_text(parts).select(F.col("doc_id").cast("long").alias("doc_id"), "textTrack")


@query(f"""
WITH {BASE}
SELECT k AS doc_id, CASE WHEN k % 9 = 8 THEN 'assign_domain' WHEN k % 2 = 0 THEN 'return_unmapped' ELSE 'remap_domain' END AS action, role || '|' || substr(trim(text, ' ' || chr(10) || chr(9)), 1, 60) || '|' || i AS "itemKey",
  CASE WHEN domain <> 'unmapped' THEN domain END AS "fromDomain", CASE WHEN k % 9 = 8 OR k % 2 = 1 THEN 'impact' END AS "toDomain", role AS "sourceHeader", CASE WHEN k % 2 = 1 THEN 'see page' END AS note
FROM t WHERE turn = 0
""")
def correction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections that moving each conversation's first turn makes."""
    _, events = edits.moved(*moves(spark, sf_dir))
    return events.select("doc_id", "action", "itemKey", "fromDomain", "toDomain", "sourceHeader", "note")


@query(f"""
WITH {BASE}, m AS (SELECT *, CASE WHEN turn <> 0 THEN domain WHEN k % 9 = 8 OR k % 2 = 1 THEN 'impact' ELSE 'unmapped' END AS now FROM t)
SELECT k AS doc_id, now AS domain, CASE WHEN turn <> 0 OR now = 'unmapped' THEN role ELSE 'General' END AS group_name, count(*) AS n, CAST(count(*) FILTER (turn = 0) AS BIGINT) AS n_by_user FROM m GROUP BY ALL
""")
def moved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each group after the moves."""
    after, _ = edits.moved(*moves(spark, sf_dir))
    return after.groupBy("doc_id", "domain", "group_name").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("mappedBy") == "user", F.lit(False))).alias("n_by_user"))


def moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, moves) of all models: each conversation's first turn goes to impact or back to the unmapped."""
    rows = items(models(spark, sf_dir))
    first = rows.where("sourcePage = 1").select(*edits.PLACE)
    k = F.col("doc_id")
    to = F.when((k % 9 == 8) | (k % 2 == 1), "impact").otherwise("unmapped")
    return rows, first.select("*", to.alias("to_domain"), F.when(k % 2 == 1, " see page ").alias("note"), F.lit("2024-01-01T00:00:00Z").alias("at"))


@query(f"""
WITH {BASE}, f AS (SELECT *, status = 'error' OR (status IN ('completed', 'editing') AND qa_status = 'Needs Review') AS flag FROM a)
SELECT k AS doc_id, status, CASE WHEN flag THEN 'flagged' WHEN status IN ('completed', 'editing') THEN 'ready' ELSE 'busy' END AS bucket,
  CASE WHEN NOT flag THEN NULL WHEN status = 'error' THEN CASE WHEN k % 8 = 2 THEN 'hard to read' ELSE 'too large' END WHEN k % 5 = 0 THEN 'first' ELSE {text_of(V.FLAG_OTHER)} END AS reason,
  total || CASE WHEN total = 1 THEN ' item' ELSE ' items' END || CASE WHEN extraction_confidence <> '' THEN ' · ' || extraction_confidence || ' confidence' ELSE '' END AS summary FROM f
""")
def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's bucket in the list of a session, and why it is flagged."""
    return sessions.flagged(files(spark, sf_dir), models(spark, sf_dir))


@query("""
SELECT n_nationkey AS id FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 9000) OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 9000)
""")
def blobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared attributes that stay when their rows are deleted, all but a few."""
    records = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("source_document_id"), "c_acctbal")
    _, blobs = sessions.deleted(records, load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), records.where("c_acctbal < 9000"))
    return blobs


@query("""
WITH t AS (SELECT s_suppkey AS k, s_suppkey % 3 AS unchanged, s_suppkey % 2 AS changed, s_suppkey % 4 AS missing_bundles, CASE WHEN s_suppkey % 11 = 0 THEN 2 ELSE 0 END AS failures, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS unblessed, s_suppkey % 7 = 0 AS update_, s_suppkey % 13 = 0 AS strict FROM supplier)
SELECT k AS doc_id, CASE WHEN failures > 0 THEN 2 WHEN unchanged + changed + unblessed = 0 THEN 2 WHEN strict AND missing_bundles > 0 THEN 2 WHEN (unblessed > 0 OR changed > 0) AND NOT update_ THEN 1 ELSE 0 END AS exit_code FROM t
""")
def regression_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tallies of a regression run come to, a supplier standing for a run."""
    k = F.col("s_suppkey")
    tally = load(spark, sf_dir, "supplier").select(
        k.alias("doc_id"), (k % 3).alias("unchanged"), (k % 2).alias("changed"), (k % 4).alias("missing_bundles"), F.when(k % 11 == 0, 2).otherwise(0).alias("failures"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("unblessed"), (k % 7 == 0).alias("update"), (k % 13 == 0).alias("require_bundles"),
    )
    return sessions.regression(tally).select("doc_id", "exit_code")


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)api key|401|unauthorized') THEN 'key' WHEN regexp_matches(text, '(?i)429|rate|quota') THEN 'rate' WHEN regexp_matches(text, '(?i)\\b404\\b|not found') THEN 'path'
  WHEN regexp_matches(text, '(?i)\\b413\\b|payload too large|request entity too large') THEN 'size' WHEN regexp_matches(text, '(?i)failed to convert|unsupported file format|vision') THEN 'read' ELSE 'text' END AS told FROM conversations
""")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the friendly texts each turn would get as an error's text."""
    service, setting = "Service", "KEY"
    told = labels.friendly_error("text", service=service, setting=setting)
    kind = F.lit("text")
    for name, (_, text) in reversed(list(zip(("key", "rate", "path", "size", "read"), V.ERRORS))):
        kind = F.when(told == text.format(service=service, setting=setting), F.lit(name)).otherwise(kind)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("told"))


@query()
def split_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splitter of run-on cells does to all models: one row."""
    return sessions.split_survey(models(spark, sf_dir))


@query()
def normalize_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all models after normalization. Its passes are tested one by one in tests/test_normalize.py."""
    texts = load(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("sourceText"))
    raw = models(spark, sf_dir).join(texts, "doc_id", "left").withColumns({"lowLegibility": F.lit(False), "textOnlyFallback": F.lit(False)})
    return items(normalize(raw)).select("doc_id", "domain", "group_ord", "group_name", "item_ord", "text", "sourceHeader", "mappedBy", "mappingConfidence")


@query()
def fidelity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts on all models after normalization."""
    raw = models(spark, sf_dir).withColumns({"sourceText": F.lit(None).cast("string"), "lowLegibility": F.col("doc_id") % 2 == 0, "textOnlyFallback": F.col("doc_id") % 5 == 0})
    out = normalize(raw)
    return out.select("doc_id", "extractionStatus", "extractionConfidence", F.array_join("extractionBlockers", " | ").alias("blockers"), "documentTypeAssessment")

