"""Page geometry: where images stand, how sharp and how large they are, tiles, columns and printed pages.

Folds that reset (a stack of matrices, the height filled so far) run along the array of one page's or one
column's rows, which a page bounds; everything else is columns and grouped sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import let
from .layout import bands

PLACED = "array<struct<image:string,width:double,height:double>>"


def product(m: Column, n: Column) -> Column:
    """The matrix (a, b, c, d, e, f) that applies m, then n."""
    row = lambda i: [m[i] * n[0] + m[i + 1] * n[2], m[i] * n[1] + m[i + 1] * n[3]]
    x, y = row(4)
    return F.array(*row(0), *row(2), x + n[4], y + n[5])


def placements(ops: DataFrame) -> DataFrame:
    """doc_id, page, nth, image, width, height: the size in points of every image when it was painted.

    ops: doc_id, page, ord, op (save, restore, transform, paint; others do nothing), matrix (six doubles, else
    the transform is left out), image (null: not painted). The outermost matrix is never taken off the stack.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "op", F.col("matrix").cast("array<double>").alias("matrix"), "image")))
    start = F.struct(F.array(F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)])).alias("stack"), F.expr(f"cast(array() as {PLACED})").alias("out"))

    def step(acc, op):
        stack, top = acc["stack"], F.element_at(acc["stack"], -1)
        under = F.slice(stack, F.lit(1), F.size(stack) - 1)
        turned = (op["op"] == "transform") & (F.size(op["matrix"]) == 6)
        moved = F.when(op["op"] == "save", F.concat(stack, F.array(top))).when((op["op"] == "restore") & (F.size(stack) > 1), under)
        moved = moved.when(turned, F.concat(under, F.array(product(op["matrix"], top)))).otherwise(stack)
        placed = F.array(F.struct(op["image"].alias("image"), F.hypot(top[0], top[1]).alias("width"), F.hypot(top[2], top[3]).alias("height")))
        out = F.when((op["op"] == "paint") & op["image"].isNotNull(), F.concat(acc["out"], placed)).otherwise(acc["out"])
        return F.struct(moved.alias("stack"), out.alias("out"))

    pages = ops.groupBy("doc_id", "page").agg(ordered.alias("ops"))
    found = pages.select("doc_id", "page", F.aggregate("ops", start, step, lambda acc: acc["out"]).alias("placed"))
    return found.select("doc_id", "page", F.posexplode("placed").alias("nth", "p")).select("doc_id", "page", "nth", "p.*")


def trusted_pages(placed: DataFrame, sizes: DataFrame, on: tuple[str, ...] = ("doc_id", "image")) -> DataFrame:
    """doc_id, page, n_images, least_dpi, trusted: whether all images of a page are sharp where they are largest.

    placed: doc_id, page, image, width, height in points; those without an area do not count. sizes: ``on``, with one
    row each, native_width, native_height in pixels; an image without a size has 0 dots an inch.
    """
    known = (F.col("native_width") > 0) & (F.col("native_height") > 0)
    dpi = F.least(F.col("native_width") / (F.col("width") / V.INCH_PT), F.col("native_height") / (F.col("height") / V.INCH_PT))
    rows = placed.where("width > 0 and height > 0").join(sizes, list(on), "left").select("doc_id", "page", "image", F.when(known, dpi).otherwise(0.0).alias("dpi"))
    worst = rows.groupBy("doc_id", "page", "image").agg(F.min("dpi").alias("dpi"))
    least = F.min("dpi")
    return worst.groupBy("doc_id", "page").agg(F.count("*").alias("n_images"), least.alias("least_dpi"), (least >= V.DPI_LEAST).alias("trusted"))


def image_dominance(sections: DataFrame, images: DataFrame) -> DataFrame:
    """section, share, dominant: images' share of each section's area. sections and images: section, width, height."""
    area = lambda: F.greatest(F.lit(0.0), F.col("width")) * F.greatest(F.lit(0.0), F.col("height"))
    covered = images.groupBy("section").agg(F.sum(area()).alias("covered"))
    share = F.coalesce("covered", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return sections.join(covered, "section", "left").select("section", share.alias("share"), (share >= V.DOMINANT_SHARE).alias("dominant"))


def tiles(width: Column, height: Column) -> Column:
    """(top, bottom) of the overlapping bands that a tall tile is cut into; a short one stays whole."""
    aspect = height / F.greatest(F.lit(1.0), width)
    n = F.when(aspect <= V.TILE_ASPECT, 1).otherwise(F.least(F.lit(V.TILE_BANDS), F.ceil(aspect / V.TILE_ASPECT).cast("int")))

    def cut(p):
        band = p["height"] / p["n"]
        lap = band * V.TILE_OVERLAP
        top = lambda i: F.when(i > 0, i * band - lap).otherwise(0.0)
        bottom = lambda i: F.when(i < p["n"] - 1, (i + 1) * band + lap).otherwise(p["height"])
        return F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: F.struct(top(i).alias("top"), bottom(i).alias("bottom")))

    return let(F.struct(height.alias("height"), n.alias("n")), cut)


def column_fractions(profile: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, lo, hi: the columns of each image page as fractions of its box; none for pages that are not cut.

    profile: doc_id, x, ink. boxes: doc_id, x0, x1, y0, y1 (pixels; null: no box), dominant.
    """
    width, height = F.col("x1") - F.col("x0"), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    cut = boxes.where(F.col("dominant") & (width > V.CROP_PX) & (width / height > V.CROP_ASPECT)).select("doc_id", "x0", "x1", width.alias("w"))
    cropped = profile.join(cut, "doc_id").where("x >= x0 and x < x1").select("doc_id", (F.col("x") - F.col("x0")).alias("x"), "ink")
    return bands(cropped).join(cut, "doc_id").select("doc_id", (F.col("lo") / F.col("w")).alias("lo"), (F.col("hi") / F.col("w")).alias("hi"))


def group_height(name: Column, texts: Column) -> Column:
    """Estimated pixels of a printed group. A text counts in UTF-16 units."""
    units = lambda t: F.octet_length(F.encode(F.coalesce(t, F.lit("")), "UTF-16BE")) / 2
    lines = F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.greatest(F.lit(1).cast("long"), F.ceil(units(t) / V.LINE_CHARS)))
    head = F.when(name.eqNullSafe(V.PLAIN_GROUP), V.PLAIN_PX).otherwise(V.HEADER_PX)
    return head + F.when(F.size(texts) > 0, lines * V.LINE_PX + V.PADDING_PX).otherwise(0)


def paginated(groups: DataFrame) -> DataFrame:
    """doc_id, column, ord, page: the printed page, from 0, on which each group of a column stands.

    groups: doc_id, column, ord, name, texts. A group opens a page when it does not fit what is left of one that
    has a group already; the first page is shorter.
    """
    rows = groups.select("doc_id", "column", "ord", group_height(F.col("name"), F.col("texts")).cast("long").alias("px"))
    columns = rows.groupBy("doc_id", "column").agg(F.array_sort(F.collect_list(F.struct("ord", "px"))).alias("all"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).cast("long").alias("filled"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, g):
        room = F.when(acc["page"] == 0, V.FIRST_PAGE_PX).otherwise(V.PAGE_PX)
        turn = (acc["filled"] > 0) & (acc["filled"] + g["px"] > room)
        page = acc["page"] + turn.cast("int")
        return F.struct(page.alias("page"), (F.when(turn, 0).otherwise(acc["filled"]) + g["px"]).alias("filled"), F.concat(acc["out"], F.array(page)).alias("out"))

    pages = F.aggregate("all", start, step, lambda acc: acc["out"])
    found = columns.select("doc_id", "column", F.explode(F.arrays_zip(F.col("all.ord").alias("ord"), pages.alias("page"))).alias("g"))
    return found.select("doc_id", "column", "g.ord", "g.page")
