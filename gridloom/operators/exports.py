"""Flat exports of models: an item a row, an outcome a row, a document a row; and the way back.

files: doc_id, file_name, status, and where known split_part_label, document_hash, error and the like.
All cells are texts; what is absent is an empty cell, never a guess.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.labels import colour_code, display_name
from ..functions.text import csv_cell, not_blank, source_format, strip
from .fidelity import document_flags
from .items import granular, items

BLOCKERS = "cast(array() as array<string>)"


def optional(df: DataFrame, name: str) -> Column:
    return df[name] if name in df.columns else F.lit(None).cast("string")


def joined(texts: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(texts, F.expr(BLOCKERS)), lambda t: t.isNotNull() & (t != "")), " | ")


def json_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.to_json(values))


def texts(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as text, absent ones empty."""
    return df.select(*[F.col(c) if c in keep else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def document_attributes(models: DataFrame, files: DataFrame) -> DataFrame:
    """What all rows of a document share. Files without a model are left out."""
    name = display_name(files["file_name"], optional(files, "split_part_label"))
    known = files.select("doc_id", "status", name.alias("source_filename"), optional(files, "document_hash").alias("document_hash"))
    shared = models.select(
        "doc_id", "organization", "program", strip("colorLegend").alias("color_legend"), F.col("extractionStatus").alias("extraction_status"),
        F.col("extractionConfidence").alias("extraction_confidence"), joined(F.col("extractionBlockers")).alias("extraction_blockers"),
        json_of(F.col("mappingCorrections")).alias("mapping_corrections_json"),
    )
    return shared.join(document_flags(models).select("doc_id", "qa_status", "document_type_flag"), "doc_id").join(known, "doc_id")


def row_id(*parts: str) -> Column:
    """The key of a row: document, field and, for an item, its group and place. Shared by all exports."""
    return F.coalesce(F.concat(F.col("doc_id").cast("string"), *[F.coalesce(F.concat(F.lit("-"), F.col(p).cast("string")), F.lit("")) for p in parts]), F.lit(""))


def flagged() -> Column:
    return F.when((~F.coalesce("verbatim", F.lit(True))) | not_blank("sourceNote"), "Yes")


def full_rows(models: DataFrame, files: DataFrame) -> DataFrame:
    """A row per overview field and item with content: the fields of the full export and those it leaves out, and the
    reading order (doc_id, domain_ord, group_ord, item_ord)."""
    rows = granular(models).join(document_attributes(models, files), "doc_id")
    header = F.coalesce(F.nullif(strip("sourceHeader"), F.lit("")), F.when(F.col("group_ord").isNotNull(), F.col("group_name")))
    cells = {
        "row_id": row_id("domain", "group_ord", "item_ord"), "fill_color": strip("fillColor"), "border_color": strip("borderColor"), "source_header": header, "source_page": F.col("sourcePage"),
        "mapped_by": F.col("mappedBy"), "mapping_confidence": F.col("mappingConfidence"), "mapping_note": strip("mappingNote"), "needs_review": flagged(), "source_note": strip("sourceNote"),
    }
    order = ("doc_id", "domain_ord", "group_ord", "item_ord")
    return texts(rows.withColumns(cells).select(*order, *[f for _, f in V.FULL_COLUMNS], *V.UNEXPORTED), order)


def unaccounted(rows: DataFrame) -> list[str]:
    """Fields of full_rows() that are neither exported nor left out on purpose: none, if all is well."""
    known = {f for _, f in V.FULL_COLUMNS} | set(V.UNEXPORTED) | {"doc_id", "domain_ord", "group_ord", "item_ord"}
    return [c for c in rows.columns if c not in known]


def coding_rows(models: DataFrame, files: DataFrame) -> DataFrame:
    """A row per outcome item of a finished document, in the columns that the coder's intake names."""
    ready = files.where(F.col("status").isin(*V.READY))
    rows = granular(models).where(F.col("domain").isin(*V.CODING)).join(document_attributes(models, ready), "doc_id")
    cells = {
        "row_id": row_id("domain", "group_ord", "item_ord"), "group": F.coalesce(F.nullif("group_name", F.lit("")), F.lit("General")), "outcome_text": F.col("content"),
        "color_coding": colour_code("fillColor", "borderColor"), "needs_review": flagged(), "source_type": F.lit(V.CODING_SOURCE),
    }
    order = ("doc_id", "domain_ord", "group_ord", "item_ord")
    return texts(rows.withColumns(cells).withColumn("domain", F.col("domain_label")).select(*order, *V.CODING_COLUMNS), order)


def log_rows(models: DataFrame, files: DataFrame) -> DataFrame:
    """A row per document that is finished or has failed, with counts and verdicts; a failed one may have no model."""
    counted = items(models).groupBy("doc_id").agg(F.count("*").alias("total_items"), F.count_if(F.col("domain") == V.UNMAPPED).alias("unmapped_items"))
    size = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    shared = models.select(
        "doc_id", "organization", "program", F.col("extractionStatus").alias("extraction_status"), F.col("extractionConfidence").alias("extraction_confidence"),
        F.col("extractionBlockers").alias("own"), F.col("layoutFamily").alias("layout_family"), size(F.col("mappingCorrections")).alias("mapping_corrections_count"),
        size(F.col("possiblyMissedRegions")).alias("possibly_missed_regions_count"), json_of(F.col("mappingCorrections")).alias("mapping_corrections_json"),
        json_of(F.col("possiblyMissedRegions")).alias("possibly_missed_regions_json"), F.lit(True).alias("has_model"),
    )
    shared = shared.join(document_flags(models).select("doc_id", "qa_status", "document_type_flag"), "doc_id").join(counted, "doc_id", "left")
    own = ("prompt_version", "prompt_variant", "model_id", "served_model_id", "split_part_label", "document_hash", "error", "warnings", "blockers", "pages_processed")
    done = files.where(F.col("status").isin(*V.READY, "error"))
    done = done.select("doc_id", "file_name", "status", *[optional(done, c).alias(c) for c in own])
    rows = done.join(shared, "doc_id", "left")
    listed = lambda c: joined(F.col(c)) if dict(rows.dtypes)[c].startswith("array") else F.col(c)
    kind = source_format("file_name")
    cells = {
        "source_filename": display_name("file_name", "split_part_label"), "pipeline_status": F.col("status"), "qa_status": F.when(F.col("has_model"), F.col("qa_status")).otherwise("Error"),
        "extraction_blockers": F.coalesce(F.when(F.col("own").isNotNull(), joined(F.col("own"))), listed("blockers")), "error_message": F.col("error"), "warnings": listed("warnings"),
        "source_format": F.when(kind.isin("docx", "pptx"), kind).otherwise("pdf"), "pages_processed": F.when(F.col("pages_processed").cast("int") > 0, F.col("pages_processed")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("total_items", "unmapped_items", "mapping_corrections_count", "possibly_missed_regions_count")},
    }
    return texts(rows.withColumns(cells).select("doc_id", *V.LOG_COLUMNS), ("doc_id",))


def csv_lines(rows: DataFrame, columns, bom: bool = False) -> DataFrame:
    """value: quoted lines of a CSV; each partition opens with the header (pairs of header and field, or fields alone)."""
    pairs = [c if isinstance(c, tuple) else (c, c) for c in columns]
    head = (V.BOM if bom else "") + ",".join('"' + h.replace('"', '""') + '"' for h, _ in pairs)
    lines = rows.select(F.concat_ws(",", *[csv_cell(f) for _, f in pairs]).alias("value"))

    def with_head(frames):
        first = True
        for frame in frames:
            if first and len(frame):
                yield pd.DataFrame({"value": [head]})
                first = False
            yield frame

    return lines.mapInPandas(with_head, "value string")


def write_csv(rows: DataFrame, columns, path: str, order: tuple[str, ...] = ("doc_id",)) -> None:
    """Files of whole CSVs, with a byte order mark each, dealt out in ranges of the order; without rows no line is written."""
    present = [c for c in order if c in rows.columns]
    csv_lines(rows.repartitionByRange(*present).sortWithinPartitions(*present), columns, bom=True).write.mode("overwrite").text(path)


def reconstituted(rows: DataFrame) -> DataFrame:
    """key, domain, group_name, text, ord of exported rows (full_rows or a file read back): by file name, or by
    organization and program where there is none. Labels that name no domain have a null domain."""
    back = F.create_map(*[F.lit(x) for d, label in V.LABELS.items() for x in (label, d)])
    key = F.when(F.col("source_filename") != "", F.col("source_filename")).otherwise(F.concat_ws("::", "organization", "program"))
    return rows.select(key.alias("key"), F.try_element_at(back, F.col("domain_label")).alias("domain"), "group_name", F.col("content").alias("text"))


def roundtrip(models: DataFrame, files: DataFrame) -> DataFrame:
    """key, domain, group_name, text, n_model, n_export: what the export has more or less often than the models.

    Overview texts count as they stand, items trimmed and under General where their group has no name.
    Nothing is returned if the export keeps every item in its place.
    """
    name = display_name(files["file_name"], optional(files, "split_part_label"))
    key = models.join(files.select("doc_id", name.alias("name")), "doc_id").select("doc_id", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat_ws("::", "organization", "program")).alias("key"))
    grouped = items(models).select("doc_id", "domain", F.coalesce(F.nullif("group_name", F.lit("")), F.lit("General")).alias("group_name"), strip("text").alias("text"))
    pairs = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"{d}.content").alias("text")) for d in V.OVERVIEW])
    plain = models.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.domain", F.lit("General").alias("group_name"), "p.text").where(not_blank("text"))
    place = ["key", "domain", "group_name", "text"]
    mine = grouped.unionByName(plain).join(key, "doc_id").groupBy(*place).agg(F.count("*").alias("n_model"))
    found = reconstituted(full_rows(models, files))
    found = found.withColumn("group_name", F.coalesce(F.nullif("group_name", F.lit("")), F.lit("General")))
    theirs = found.groupBy(*place).agg(F.count("*").alias("n_export"))
    both = mine.join(theirs, place, "full_outer").fillna(0, ["n_model", "n_export"])
    return both.where("n_model <> n_export")


def printed_columns(models: DataFrame) -> DataFrame:
    """doc_id, ord, title, domain of the columns that a printed grid of each model has."""
    has = lambda d: F.exists(F.coalesce(F.col(f"{d}.content"), F.expr("array()")), lambda g: F.exists(F.coalesce(g["items"], F.expr("array()")), lambda i: not_blank(i["text"])))
    swap = ~(has(V.PRINTED_OUTCOMES[0][1]) | has(V.PRINTED_OUTCOMES[1][1]) | has(V.PRINTED_OUTCOMES[2][1])) & has("generalOutcomes")
    plan = lambda pairs: F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("domain")) for t, d in pairs])
    columns = F.when(swap, plan(V.PRINTED + V.PRINTED_GENERAL)).otherwise(plan(V.PRINTED + V.PRINTED_OUTCOMES))
    return models.select("doc_id", F.posexplode(columns).alias("ord", "c")).select("doc_id", "ord", "c.*")
