"""Ordered operators on profiles, intervals and lines: bands, headings, carried marks, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import squeeze, strip


def normalized_ink(profile: DataFrame) -> DataFrame:
    """profile: doc_id, x, ink. ink over its 95th percentile (by index), at most 1."""
    n, values = F.size("v"), F.col("v")
    pick = F.element_at(values, F.least(n - 1, F.floor(n * 0.95).cast("int")) + 1)
    level = profile.groupBy("doc_id").agg(F.array_sort(F.collect_list("ink")).alias("v")).select("doc_id", pick.alias("p"), F.element_at(values, -1).alias("top"))
    level = level.select("doc_id", F.when(F.col("p") > 0, F.col("p")).when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("level"))
    return profile.join(level, "doc_id").select("doc_id", "x", F.least(F.lit(1.0), F.col("ink") / F.col("level")).alias("ink"))


def bands(profile: DataFrame) -> DataFrame:
    """doc_id, lo, hi (exclusive) of the columns that a profile (x from 0, gapless) shows.

    Runs of ink; narrow gaps close, narrow runs go; three to nine must be left.
    """
    along = Window.partitionBy("doc_id").orderBy("x")
    width = F.count("*").over(Window.partitionBy("doc_id")).alias("w")
    rows = normalized_ink(profile).select("doc_id", "x", "ink", width).where((F.col("ink") > V.INK) & (F.col("w") >= V.WIDTH_LEAST))
    gap = F.greatest(F.lit(1), F.floor(F.col("w") * V.GUTTER))
    empty = F.col("x") - F.lag("x").over(along) - 1
    starts = F.coalesce((empty > 0) & (empty >= gap), F.lit(True))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(along))
    runs = rows.groupBy("doc_id", "run").agg(F.min("x").alias("lo"), (F.max("x") + 1).alias("hi"), F.first("w").alias("w"))
    runs = runs.where(F.col("hi") - F.col("lo") >= F.greatest(F.lit(1), F.floor(F.col("w") * V.BAND)))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return runs.withColumn("n", n).where(F.col("n").between(V.BANDS_LEAST, V.BANDS_MOST)).select("doc_id", "lo", "hi")


def headings(lines: DataFrame) -> DataFrame:
    """lines: doc_id, line_no, text, height. Adds is_heading: height over the upper median's, not long."""
    middle = F.element_at(F.array_sort(F.collect_list("height")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    mid = lines.groupBy("doc_id").agg(middle.alias("mid"))
    return lines.join(mid, "doc_id").withColumn("is_heading", (F.col("mid") > 0) & (F.col("height") >= V.HEADING_RATIO * F.col("mid")) & (F.length("text") <= V.HEADING_CHARS)).drop("mid")


def carried(rows: DataFrame, mark: Column, order: str = "line_no", name: str = "page") -> DataFrame:
    """The last mark so far, for each row of a document."""
    so_far = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(mark, ignorenulls=True).over(so_far))


def runs_to_lines(runs: DataFrame) -> DataFrame:
    """runs: doc_id, run_no, str, height, eol. doc_id, line_no, text, height of the lines they make."""
    before = Window.partitionBy("doc_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("line_no", F.coalesce(F.sum(F.col("eol").cast("int")).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "str"))), lambda x: x["str"]), "")
    lines = rows.groupBy("doc_id", "line_no").agg(F.trim(text).alias("text"), F.max("height").alias("height"))
    return lines.where("text <> ''")


def page_groups(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, start, end_: page groups that tile pages 1 to n; else the whole document as one group.

    groups: doc_id, ord, start, end_ (double). pages: doc_id, n. The first twenty groups count.
    """
    n = Window.partitionBy("doc_id")
    along = n.orderBy("start", "ord")
    rows = groups.where(F.col("ord") < V.GROUPS_MOST).select("doc_id", "ord", F.floor(F.col("start") + 0.5).alias("start"), F.floor(F.col("end_") + 0.5).alias("end_")).join(pages, "doc_id")
    fits = F.coalesce((F.col("start") >= 1) & (F.col("end_") >= F.col("start")) & (F.col("end_") <= F.col("n")), F.lit(False))
    follows = F.col("start") == F.coalesce(F.lag("end_").over(along), F.lit(0)) + 1
    rows = rows.withColumn("ok", fits & F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("all_ok", F.min("ok").over(n) & (F.max("end_").over(n) == F.col("n"))).where("all_ok").select("doc_id", "start", "end_")
    whole = pages.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).cast("long").alias("start"), F.col("n").cast("long").alias("end_"))
    return rows.unionByName(whole)


def page_texts(runs: DataFrame) -> DataFrame:
    """doc_id, text: a document's text from the runs of its pages, each page under its marker and its large lines as headings.

    runs: doc_id, page, run_no, str, height, eol; a run without a string only ends lines, and a page whose runs have none
    keeps its marker. A line is as high as its highest run; a page's heights are judged by its own upper median.
    """
    before = Window.partitionBy("doc_id", "page").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("line_no", F.coalesce(F.sum(F.coalesce("eol", F.lit(False)).cast("int")).over(before), F.lit(0)))
    some = F.coalesce("str", F.lit("")) != ""
    words = F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("run_no", "str")))), lambda x: x["str"])
    height = F.coalesce(F.max(F.when(some, F.abs("height"))), F.lit(0)).cast("double")
    lines = rows.groupBy("doc_id", "page", "line_no").agg(squeeze(F.array_join(words, " ")).alias("text"), height.alias("height"))
    full = F.col("text") != ""
    heights = F.array_sort(F.collect_list(F.when(full & (F.col("height") > 0), F.col("height"))))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(full, F.struct("line_no", "text", "height")))).alias("lines"), heights.alias("heights"))
    pages = pages.withColumn("mid", F.try_element_at("heights", (F.floor(F.size("heights") / 2) + 1).cast("int")))
    heads = lambda x: (x["height"] >= V.HEADING_RATIO * F.col("mid")) & (F.length(x["text"]) <= V.HEADING_CHARS)
    body = F.array_join(F.transform("lines", lambda x: F.when(heads(x), F.concat(F.lit("### "), x["text"])).otherwise(x["text"])), "\n")
    marked = F.concat(F.lit("\n\n## Page "), F.col("page").cast("string"), F.lit("\n\n"), body)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("text")))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(strip(F.array_join(in_order, "")).alias("text"))
