"""Readers of saved answers, fixtures, specs and bundles: declared schemas, malformed rows kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_supported, not_blank, source_format
from .schema import BUNDLE, FIXTURE, MODEL, REQUIRED, SPEC



def model_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem) and the model of each JSON file."""
    return spark.read.schema(MODEL).option("multiLine", True).json(path).withColumn("doc_id", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))


def fixture_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, the raw model's columns, sourceText, lowLegibility, textOnlyFallback."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    return raw.select(F.col("id").alias("doc_id"), "raw.*", "options.*")


def spec_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPEC).option("multiLine", True).json(path).withColumnRenamed("id", "doc_id")


def parse_models(answers: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(models, rejects) of answer texts: doc_id, and the model's columns or an error.

    Errors: no answer; not JSON; required keys missing (named).
    """
    parsed = answers.withColumn("m", F.from_json(F.col(text), MODEL, {"mode": "PERMISSIVE"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"m.{k}").isNull(), F.lit(k)) for k in REQUIRED]))
    is_json = F.coalesce(F.expr(f"try_variant_get(try_parse_json({text}), '$', 'variant')").isNotNull(), F.lit(False))
    error = (
        F.when(F.coalesce(F.col(text), F.lit("")) == "", "No response from AI.").when(~is_json, "not valid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
    )
    parsed = parsed.withColumn("error", error)
    return parsed.where("error is null").select("doc_id", "m.*"), parsed.where("error is not null").select("doc_id", "error")


def json_body(body: Column | str) -> Column:
    """A request body as JSON, or an empty object."""
    c = F.col(body) if isinstance(body, str) else body
    return F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("{}")))


def parse_bundles(rows: DataFrame, text: str = "body") -> DataFrame:
    """doc_id and the bundle's columns; bundles with neither an image nor text are left out.

    imageRefs count only as a whole: as many as images, all with a page from 1.
    """
    b = rows.withColumn("b", F.from_json(F.col(text), BUNDLE)).select("doc_id", "b.*")
    images = F.filter(F.coalesce("images", F.expr("cast(array() as array<string>)")), not_blank)
    whole = (F.size("imageRefs") == F.size(images)) & F.forall("imageRefs", lambda r: F.coalesce((r["page"] >= 1) & (r["column"].isNull() | (r["column"] >= 1)), F.lit(False)))
    b = b.withColumns({"imageRefs": F.when(whole, F.col("imageRefs")), "images": images})
    return b.where((F.size("images") > 0) | not_blank("textTrack"))


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder: path, file_name, format, content, document_hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    accepted = files.where(is_supported("file_name")).select("path", "file_name", source_format("file_name").alias("format"), "content", F.substring(F.sha2("content", 256), 1, 16).alias("document_hash"))
    return accepted, files.where(~is_supported("file_name")).select("path", "file_name")


def spec_violations(specs: DataFrame) -> DataFrame:
    """doc_id, rule: specs without slides, columns without items, and splits that the page does not print."""
    columns = specs.select("doc_id", F.explode_outer("slides").alias("s")).select("doc_id", F.explode_outer("s.columns").alias("c"))
    unprinted = F.exists(F.map_keys("c.splits"), lambda k: ~F.array_contains("c.items", k))
    foreign = F.exists(F.map_entries("c.splits"), lambda e: F.exists(e["value"], lambda part: ~F.contains(e["key"], part)))
    rule = F.when(F.col("c").isNull() | F.col("c.items").isNull() | F.col("c.heading").isNull(), "incomplete column").when(F.coalesce(unprinted, F.lit(False)), "split of an item not printed").when(F.coalesce(foreign, F.lit(False)), "split part not in its item")
    return columns.select("doc_id", rule.alias("rule")).where("rule is not null").union(specs.where(is_blank("doc_id") | F.col("slides").isNull()).select("doc_id", F.lit("not a spec")))


def golden(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected, tolerated): doc_id, domain, ord, text of the items that a grid should hold, and
    doc_id, text of wording that may turn up anywhere."""
    slides = specs.select("doc_id", F.posexplode("slides").alias("slide_no", "s"))
    columns = slides.select("doc_id", "slide_no", F.posexplode("s.columns").alias("column_no", "c"))
    printed = columns.select("doc_id", "slide_no", "column_no", "c.domain", "c.labels", "c.splits", F.posexplode("c.items").alias("item_no", "item"))
    is_label = F.coalesce(F.array_contains("labels", F.col("item")), F.lit(False))
    expected = printed.where(F.col("domain").isNotNull() & ~is_label)
    parts = F.coalesce(F.try_element_at("splits", F.col("item")), F.array("item"))
    expected = expected.select("doc_id", "domain", "slide_no", "column_no", "item_no", F.posexplode(parts).alias("part_no", "text"))
    expected = expected.select("doc_id", "domain", F.struct("slide_no", "column_no", "item_no", "part_no").alias("ord"), "text")
    tolerated = (
        slides.select("doc_id", F.col("s.title").alias("text"))
        .union(columns.where(F.col("c.heading") != "").select("doc_id", "c.heading"))
        .union(printed.where(F.col("domain").isNull() | is_label).select("doc_id", "item"))
    )
    return expected, tolerated


def spec_text(specs: DataFrame) -> DataFrame:
    """doc_id, text: a spec as the text of its pages, in reading order."""
    line = lambda c: F.flatten(F.array(F.when(c["heading"] != "", F.array(F.concat(F.lit("#### "), c["heading"]), F.lit(""))).otherwise(F.expr("cast(array() as array<string>)")), F.transform(c["items"], lambda i: F.concat(F.lit("- "), i)), F.array(F.lit(""))))
    page = lambda s, i: F.concat(F.array(F.concat(F.lit("## Slide "), (i + 1).cast("string")), F.lit(""), F.concat(F.lit("### "), s["title"]), F.lit("")), F.flatten(F.transform(s["columns"], line)))
    return specs.select("doc_id", F.array_join(F.flatten(F.transform("slides", page)), "\n").alias("text"))
