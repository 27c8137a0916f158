"""Document-level verdicts: signals of a model, then one cascade of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.headers import column_of, is_input_subbucket, label_of, synonym_of
from ..functions.text import bare_header, is_blank, norm_header, not_blank, strip
from . import coverage
from .items import extracted_text, groups_of

TEXTS = "cast(array() as array<string>)"


def first_wins(texts: Column, most: int = V.BLOCKERS_MOST) -> Column:
    """Texts without repeats (case aside), nulls and blanks; the first ``most``."""
    known = lambda acc, t: F.exists(acc, lambda a: F.lower(a) == F.lower(t))
    keep = lambda acc, t: F.when((F.size(acc) >= most) | is_blank(t) | known(acc, t), acc).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(F.coalesce(texts, F.expr(TEXTS)), F.expr(TEXTS), lambda acc, t: keep(acc, strip(t)))


def regions(raw: Column) -> Column:
    """Missed regions that are valid, their pages rounded, one for each page and span, at most six."""
    valid = F.filter(F.coalesce(raw, F.expr("cast(array() as array<struct<page:double,xStart:double,xEnd:double,note:string>>)")), lambda r: F.coalesce((r["page"] >= 1) & (r["page"] < float("inf")), F.lit(False)))

    def tidy(r):
        span = F.coalesce((r["xStart"] >= 0) & (r["xEnd"] <= 1) & (r["xEnd"] > r["xStart"]), F.lit(False))
        return F.struct(
            F.floor(r["page"] + 0.5).cast("double").alias("page"), F.when(span, r["xStart"]).alias("xStart"), F.when(span, r["xEnd"]).alias("xEnd"),
            F.nullif(F.substring(strip(r["note"]), 1, 200), F.lit("")).alias("note"),
        )

    key = lambda r: F.concat_ws(":", r["page"].cast("string"), F.round(r["xStart"], 2).cast("string"), F.round(r["xEnd"], 2).cast("string"))
    rows = F.transform(valid, tidy)
    keys = F.transform(rows, key)
    return F.slice(F.filter(rows, lambda r, i: F.array_position(keys, key(r)) == i + 1), 1, V.REGIONS_MOST)


def group_signals(models: DataFrame) -> DataFrame:
    """A row for each document with a group: items, unmapped items, distinct section headers (General
    aside), those that name some column, and the groups headed with another column's name."""
    per_domain = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(i).alias("domain_ord"), groups_of(d).alias("groups")) for i, d in enumerate(V.GROUPED)])
    rows = models.select("doc_id", F.explode(per_domain).alias("d")).select("doc_id", "d.domain", "d.domain_ord", F.posexplode("d.groups").alias("group_ord", "g"))
    rows = rows.select(
        "doc_id", "domain", "domain_ord", "group_ord", F.coalesce("g.name", F.lit("")).alias("name"), F.size("g.items").alias("size"),
        F.size(F.filter("g.items", lambda i: not_blank(i["text"]))).alias("live"),
    )
    rows = rows.withColumns({"header": norm_header("name"), "bare": bare_header("name")})
    grid = F.col("domain") != V.UNMAPPED
    names_some = synonym_of("header", "bare").isNotNull() | ((F.col("domain") == "inputs") & is_input_subbucket("name"))
    section = F.when(~F.col("header").isin("", "general"), F.col("header"))
    other = grid & F.coalesce(column_of("bare") != F.col("domain"), F.lit(False)) & (F.col("size") > 0)
    text = F.concat(F.lit(V.BLOCKERS["groupNamesOtherColumn"] + ' ("'), "name", F.lit('" is in '), label_of("domain", V.FIELD_LABELS), F.lit(")"))
    found = rows.groupBy("doc_id").agg(
        F.sum("live").alias("s_n"), F.sum(F.when(~grid, F.col("live")).otherwise(0)).alias("s_unmapped"), F.count_distinct(section).alias("s_sections"),
        F.count_distinct(F.when(grid & names_some, section)).alias("s_mapped"), F.array_sort(F.collect_list(F.when(other, F.struct("domain_ord", "group_ord", text.alias("text"))))).alias("m"),
    )
    return found.withColumn("s_misheaded", F.transform("m", lambda x: x["text"])).drop("m")


def suggests_mismatch(n: Column, unmapped: Column, sections: Column, mapped: Column, layout: Column) -> Column:
    """Much of a document fits no column: by share, by headers left over, or by layout."""
    loose = F.coalesce(layout, F.lit("vertical_columns")).isin("horizontal_rows", "diagram", "prose_sections", "unknown")
    share = unmapped / F.greatest(n, F.lit(1))
    return (n >= 6) & (((n >= 8) & (share >= 0.3)) | ((unmapped >= 5) & (sections - mapped >= 2)) | (loose & (share >= 0.15)))


def signals(models: DataFrame) -> DataFrame:
    """``models`` with the signals that the cascade reads, as columns s_...; one join by doc_id."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in models.columns else F.lit(False)
    m = models.join(group_signals(models), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("s_n", "s_unmapped", "s_sections", "s_mapped")})
    overview = F.lit(False)
    for f in V.OVERVIEW:
        overview = overview | not_blank(f"{f}.content")
    status_known, type_known = F.coalesce(F.col("extractionStatus").isin(*V.STATUSES), F.lit(False)), F.coalesce(F.col("documentTypeAssessment").isin(*V.ASSESSMENTS), F.lit(False))
    return m.withColumns(
        {
            "s_grid": F.col("s_n") - F.col("s_unmapped"), "s_low": flag("lowLegibility"), "s_text_only": flag("textOnlyFallback"),
            "s_mismatch": suggests_mismatch(F.col("s_n"), F.col("s_unmapped"), F.col("s_sections"), F.col("s_mapped"), F.col("layoutFamily")),
            "s_unknown_layout": F.coalesce(F.col("layoutFamily") == "unknown", F.lit(False)), "s_no_content": (F.col("s_n") == 0) & ~overview,
            "s_own": first_wins(F.col("extractionBlockers")), "s_misheaded": F.coalesce("s_misheaded", F.expr(TEXTS)),
            "s_regions": regions(F.col("possiblyMissedRegions")), "s_status_known": status_known, "s_type_known": type_known,
            "s_status": F.when(status_known, F.col("extractionStatus")).otherwise("partial"),
            "s_type": F.when(type_known, F.col("documentTypeAssessment")).otherwise("unclear"),
        }
    )


def with_uncovered(models: DataFrame) -> DataFrame:
    """Add ``uncovered``: pages whose grid did not come back. Without source texts there are none."""
    none = F.expr("cast(array() as array<int>)")
    if "sourceText" not in models.columns:
        return models.withColumn("uncovered", none)
    marked = models.where(F.col("sourceText").rlike(r"(?im)^\s*##\s+(page|slide)\s+\d+\s*$") & (F.col("s_n") > 0))
    flagged = coverage.uncovered_pages(marked.select("doc_id", "sourceText"), extracted_text(marked))
    flagged = flagged.select("doc_id", F.transform("pages", lambda p: p["page"]).alias("uncovered"))
    return models.join(flagged, "doc_id", "left").withColumn("uncovered", F.coalesce("uncovered", none))


def reconcile(models: DataFrame) -> DataFrame:
    """Status, confidence and reasons from the signals; a status is never made milder."""
    m = with_uncovered(signals(models))
    s = lambda name: F.col(f"s_{name}")
    doubtful_type, empty_grid, dense = s("type") != "logic_model", s("n") == 0, s("low") & (s("n") >= 6)
    doubt = (
        s("mismatch") | s("unknown_layout") | doubtful_type | s("text_only") | empty_grid | dense | (F.size(s("own")) > 0) | s("no_content")
        | (F.size(s("regions")) > 0) | (F.size("uncovered") > 0) | (F.size(s("misheaded")) > 0)
    )
    gave_up = s("status") == "abstained"
    m = m.withColumn("s_verdict", F.when((s("status") == "ok") & doubt, "partial").otherwise(s("status")))
    status = s("verdict")
    say = lambda cond, key: F.when(cond, F.lit(V.BLOCKERS[key]))
    type_text = F.when(s("grid") > 0, V.BLOCKERS["noColumnGrid"]).otherwise(V.BLOCKERS["notLogicModel"])
    note = F.nullif(F.col("documentTypeNote"), F.lit(""))
    noted = F.when(note.isNotNull(), F.concat(type_text, F.lit(" ("), note, F.lit(")"))).otherwise(type_text)
    reasons = F.concat(
        s("own"),
        F.array(
            say(~s("status_known"), "statusNotReported"), say(~s("type_known"), "documentTypeNotReported"), say(s("no_content"), "noContent"),
            say(~s("no_content") & empty_grid, "noGridItems"), say(s("text_only"), "textOnlyFallback"), say(dense, "lowLegibilityDense"),
            say(s("low") & ~dense & (status == "partial"), "lowLegibilityPartial"), say(s("mismatch"), "mismatch"), say(s("unknown_layout"), "unknownLayout"),
            F.when(doubtful_type, noted), say(F.size(s("regions")) > 0, "possiblyIncomplete"),
            F.when(F.size("uncovered") > 0, F.concat(F.lit(V.BLOCKERS["pageNotExtracted"] + " ("), coverage.named_pages(F.col("uncovered")), F.lit(")"))),
        ),
        F.slice(s("misheaded"), 1, 2),
    )
    m = m.withColumn("s_all", F.when(gave_up, F.concat(F.array(F.lit(V.BLOCKERS["abstained"])), s("own"))).otherwise(reasons))
    m = m.withColumn("s_reasons", first_wins(F.col("s_all")))
    reasons = s("reasons")
    confidence = F.when(gave_up | s("no_content"), "low").when((status == "partial") | s("mismatch") | s("unknown_layout") | s("low"), "medium").otherwise("high")
    return m.withColumns(
        {
            "extractionStatus": status,
            "extractionConfidence": confidence,
            "extractionBlockers": F.when(F.size(reasons) > 0, reasons),
            "documentTypeAssessment": s("type"),
            "possiblyMissedRegions": F.when(gave_up, F.col("possiblyMissedRegions")).when(F.size(s("regions")) > 0, s("regions")),
        }
    ).drop("uncovered", *[c for c in m.columns if c.startswith("s_")])


def clamp(models: DataFrame) -> DataFrame:
    """Optional verdict fields that are not valid become absent."""
    valid = lambda name, names: F.when(F.col(name).isin(*names), F.col(name))
    own, found = first_wins(F.col("extractionBlockers")), regions(F.col("possiblyMissedRegions"))
    return models.withColumns(
        {
            "extractionStatus": valid("extractionStatus", V.STATUSES),
            "extractionConfidence": valid("extractionConfidence", V.CONFIDENCES),
            "documentTypeAssessment": valid("documentTypeAssessment", V.ASSESSMENTS),
            "documentTypeNote": F.nullif(F.substring(strip("documentTypeNote"), 1, 200), F.lit("")),
            "possiblyMissedRegions": F.when(F.size(found) > 0, found),
            "extractionBlockers": F.when(F.size(own) > 0, own),
        }
    )


def hard_stop(status: Column, confidence: Column) -> Column:
    return F.coalesce(status == "abstained", F.lit(False)) | F.coalesce(confidence == "low", F.lit(False))


def soft_gate(status: Column, confidence: Column) -> Column:
    return F.coalesce(status == "partial", F.lit(False)) | F.coalesce(confidence == "medium", F.lit(False))


def banner(status: Column, confidence: Column) -> Column:
    return soft_gate(status, confidence) & ~hard_stop(status, confidence)


def stop_message(blockers: Column) -> Column:
    texts = first_wins(blockers)
    n, head = F.size(texts), F.concat(F.lit(V.STOP_ONE), F.try_element_at(texts, F.lit(1)))
    more = F.concat(head, F.lit(" (and "), (n - 1).cast("string"), F.lit(" other reason"), F.when(n > 2, "s").otherwise(""), F.lit(")"))
    return F.when(n == 0, F.lit(V.STOP_NONE)).when(n == 1, head).otherwise(more)


def type_flag(assessment: Column, grid: Column) -> Column:
    out = F.lit("")
    for (kind, filled), text in V.TYPE_FLAGS.items():
        out = F.when((assessment == kind) & ((grid > 0) == F.lit(filled)), F.lit(text)).otherwise(out)
    return out


def qa_label(needs: Column) -> Column:
    return F.when(needs, V.QA_REVIEW).otherwise(V.QA_OK)


def document_flags(models: DataFrame) -> DataFrame:
    """doc_id, total_items, unmapped_items, qa_status, document_type_flag of each model."""
    m = signals(models)
    needs = banner(F.col("extractionStatus"), F.col("extractionConfidence")) | F.col("s_mismatch")
    return m.select(
        "doc_id", F.col("s_n").alias("total_items"), (F.col("s_n") - F.col("s_grid")).alias("unmapped_items"), qa_label(needs).alias("qa_status"),
        type_flag(F.col("documentTypeAssessment"), F.col("s_grid")).alias("document_type_flag"),
    )


__all__ = ["banner", "clamp", "document_flags", "hard_stop", "label_of", "qa_label", "reconcile", "regions", "signals", "soft_gate", "stop_message", "type_flag"]
