"""The first way of drawing a document's pages that fits its budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V

#: All ways in the order in which they are tried: (phase, quality, scale of pages of text, scale of image pages).
WAYS = [(1, q, s, 1.0) for q in V.QUALITIES for s in V.SCALES] + [(2, q, s, s) for q in V.QUALITIES for s in V.SCALES]


def ways() -> F.Column:
    """The 32 ways as an array."""
    return F.array(*[F.struct(F.lit(i).alias("way"), F.lit(p).alias("phase"), F.lit(q).alias("quality"), F.lit(s).alias("scale"), F.lit(v).alias("image_scale")) for i, (p, q, s, v) in enumerate(WAYS)])


def payload(sizes: DataFrame) -> DataFrame:
    """doc_id, bytes: characters of all encoded pages of a document. sizes: doc_id, chars (null: none)."""
    return sizes.groupBy("doc_id").agg(F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("bytes"))


def first_fit(pages: DataFrame, chars, budget: int = V.PAYLOAD_BYTES) -> DataFrame:
    """doc_id, phase, quality, scale, image_scale, bytes, fits: the way in which each document's pages are sent.

    pages: doc_id, is_image, and what ``chars(quality, scale)`` reads, which gives the encoded characters of a page drawn so.
    First pages of text lose quality, then size, image pages staying whole; only if that is not enough all pages do. The first
    way that fits counts; if none does, the last one tried. A document of image pages only skips the first phase, one without any the
    second. One aggregate holds the sums of all ways of a document; a document of any number of pages is summed in parts.
    """
    column = [f"w{i}" for i in range(len(WAYS))]
    image = F.coalesce("is_image", F.lit(False))
    sums = [F.sum(F.coalesce(F.when(image, chars(F.lit(q), F.lit(v))).otherwise(chars(F.lit(q), F.lit(s))), F.lit(0))).cast("long").alias(c) for c, (_, q, s, v) in zip(column, WAYS)]
    totals = pages.groupBy("doc_id").agg(F.max(image).alias("images"), F.max(~image).alias("texts"), *sums)
    tried = F.filter(F.zip_with(ways(), F.array(*column), lambda w, n: F.struct(w["way"].alias("way"), w["phase"].alias("phase"), w["quality"].alias("quality"), w["scale"].alias("scale"), w["image_scale"].alias("image_scale"), n.alias("bytes"))),
                     lambda w: F.when(w["phase"] == 1, F.col("texts")).otherwise(F.col("images")))
    totals = totals.select("doc_id", tried.alias("tried"))
    fit = F.get(F.filter("tried", lambda w: w["bytes"] <= budget), F.lit(0))
    out = totals.select("doc_id", F.coalesce(fit, F.element_at("tried", -1)).alias("w"))
    return out.select("doc_id", "w.phase", "w.quality", "w.scale", "w.image_scale", "w.bytes", (F.col("w.bytes") <= budget).alias("fits"))
