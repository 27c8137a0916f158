"""Bundles of a document: put together, and cut to page ranges.

A bundle: doc_id, images, imageRefs (page and column of each), previewImages (a page each), textTrack,
warnings, sourceFormat. ranges: doc_id, start, end_ (pages from 1, the end inclusive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import hygiene, is_blank, strip

PAGE_WARNING = r"^Page (\d+) of this\b"
REFS = "array<struct<page:int,column:int>>"


def low_legibility(warnings: Column) -> Column:
    """Whether a warning says that pages are hard to read."""
    return F.exists(warnings, lambda w: F.contains(w, F.lit("flattened-raster")) | w.rlike("(?i)low[- ]resolution"))


def without_images(images: Column) -> Column:
    return F.size(images) == 0


def assembled(bundles: DataFrame) -> DataFrame:
    """Bundles made whole: the legibility warning once, previews and page refs by default, no binary text.

    lowLegibility, if present, asks for the warning; it is dropped.
    """
    low = F.coalesce(F.col("lowLegibility"), F.lit(False)) if "lowLegibility" in bundles.columns else F.lit(False)
    warned = F.when(low & ~low_legibility(F.col("warnings")), F.concat("warnings", F.array(F.lit(V.LOW_LEGIBILITY)))).otherwise(F.col("warnings"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    pages = F.transform("images", lambda _, i: F.struct((i + 1).alias("page"), F.lit(None).cast("int").alias("column"))).cast(REFS)
    refs = F.when(F.size("images") > 0, F.when(F.size("imageRefs") == F.size("images"), F.col("imageRefs").cast(REFS)).otherwise(pages))
    return bundles.withColumns({"warnings": warned, "previewImages": F.coalesce(some("previewImages"), some("images")), "imageRefs": refs, "textTrack": hygiene("textTrack")}).drop("lowLegibility")


def text_only(docs: DataFrame, source_format: Column, warnings: Column | None = None) -> DataFrame:
    """Bundles without images, of docs (doc_id, textTrack)."""
    none = "cast(array() as array<string>)"
    return docs.select("doc_id", F.expr(none).alias("images"), F.expr(none).alias("previewImages"), F.expr(f"cast(array() as {REFS})").alias("imageRefs"), "textTrack", (F.expr(none) if warnings is None else warnings).alias("warnings"), source_format.alias("sourceFormat"))


def sliced_warnings(warnings: Column, start: Column, end: Column) -> Column:
    """Warnings of no page, and those of pages in range with their new number."""
    page = lambda w: F.regexp_extract(w, PAGE_WARNING, 1).cast("int")
    kept = F.filter(warnings, lambda w: ~w.rlike(PAGE_WARNING) | page(w).between(start, end))
    new = lambda w: F.concat(F.lit("Page "), (page(w) - start + 1).cast("string"), F.regexp_replace(w, r"^Page \d+", ""))
    return F.transform(kept, lambda w: F.when(w.rlike(PAGE_WARNING), new(w)).otherwise(w))


def sliced_text(texts: DataFrame) -> DataFrame:
    """doc_id, start, end_, textTrack: the sections of the pages in range, their markers renumbered.

    texts: doc_id, start, end_, textTrack. A text without markers, or blank, stays whole. Lines carry the last
    marker forward; a text of any length is as many rows as it has lines.
    """
    keys = ["doc_id", "start", "end_"]
    lines = texts.select(*keys, F.posexplode(F.split("textTrack", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("label", F.regexp_extract(strip("line"), V.PAGE_MARKER, 1))
    lines = lines.withColumn("mark", F.when(F.col("label") != "", F.regexp_extract(strip("line"), V.PAGE_MARKER, 2).cast("int")))
    page = F.last("mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("page", page)
    own = F.when(F.col("mark").isNotNull(), F.concat(F.lit("## "), "label", F.lit(" "), (F.col("mark") - F.col("start") + 1).cast("string"))).otherwise(F.col("line"))
    inside = F.when(F.col("page").between(F.col("start"), F.col("end_")), F.struct("line_no", own.alias("line")))
    cut = lines.groupBy(*keys).agg(F.count("mark").alias("marks"), F.array_sort(F.collect_list(inside)).alias("kept"))
    cut = cut.select(*keys, "marks", strip(F.array_join(F.transform("kept", lambda x: x["line"]), "\n")).alias("cut"))
    whole = is_blank("textTrack") | (F.coalesce("marks", F.lit(0)) == 0)
    return texts.join(cut, keys, "left").select(*keys, F.when(whole, F.col("textTrack")).otherwise(F.col("cut")).alias("textTrack"))


def sliced(bundles: DataFrame, ranges: DataFrame) -> DataFrame:
    """A bundle for each range: start, end_, and the bundle's columns cut to it, pages numbered from 1 anew.

    Images are cut by their refs; without a ref for each image all of them stay.
    """
    rows = bundles.join(ranges, "doc_id")
    first = F.col("start") - 1
    inside = F.filter(F.arrays_zip("images", "imageRefs"), lambda z: z["imageRefs"]["page"].between(F.col("start"), F.col("end_")))
    exact = F.size("imageRefs") == F.size("images")
    moved = F.transform(inside, lambda z: F.struct((z["imageRefs"]["page"] - first).cast("int").alias("page"), z["imageRefs"]["column"].alias("column"))).cast(REFS)
    cut = rows.withColumns(
        {
            "previewImages": F.slice("previewImages", F.col("start"), F.greatest(F.col("end_") - first, F.lit(0))),
            "warnings": sliced_warnings(F.col("warnings"), F.col("start"), F.col("end_")),
            "new_images": F.when(exact, F.transform(inside, lambda z: z["images"])).otherwise(F.col("images")),
            "new_refs": F.when(exact, moved).otherwise(F.col("imageRefs").cast(REFS)),
        }
    )
    cut = cut.drop("images", "imageRefs").withColumnsRenamed({"new_images": "images", "new_refs": "imageRefs"})
    keys = ["doc_id", "start", "end_"]
    return cut.drop("textTrack").join(sliced_text(rows.select(*keys, "textTrack")), keys)


def pages_in_range(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of pages (doc_id, page, ...) in each range, with page counted from the range's start."""
    rows = pages.join(ranges, "doc_id").where(F.col("page").between(F.col("start"), F.col("end_")))
    return rows.withColumn("page", F.col("page") - F.col("start") + 1)
