"""Pages of a text that hold a grid whose wording did not come back."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import vocab as V
from ..functions.headers import key_forms, synonym_dimension
from ..functions.text import WS, bare_header, char_grams, norm_header, strip


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition, a-z and 0-9 only."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if c.isascii() and c.isalnum()))


def pages(texts: DataFrame, text: str = "sourceText") -> DataFrame:
    """doc_id, page, text: lines under each page marker; what stands before the first is no page."""
    lines = texts.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    mark = F.regexp_extract(strip("line"), V.PAGE_MARKER, 2)
    lines = lines.withColumn("mark", F.when(mark != "", mark.cast("int")))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("page", F.last("mark", ignorenulls=True).over(so_far)).where("page is not null")
    body = F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), F.struct("line_no", "line"))))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(body, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))


#: Words of which every synonym has one: windows without them need no closer look.
KEYWORDS = "outcomes|short|medium|long|near|impact|resources|inputs|enablers|activities|interventions|outputs|deliverables|products|reach"


def grid_pages(all_pages: DataFrame) -> DataFrame:
    """doc_id, page of the pages on which one, two or three words in a row name, loosely, three
    columns or more, one of structure and one of results among them.

    Each distinct window of a page is laid out in the forms that a key may have and meets the fixed keys in an
    equi-join; the longest key names it. Pages without words, or with null text, hold no grid. A page is one row
    however often it is given."""
    words = F.filter(F.split("text", f"{WS}+"), lambda w: w != "")
    rows = all_pages.select("doc_id", "page", words.alias("words")).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)))))
    rows = rows.select("doc_id", "page", F.explode(F.array(*[F.array_join(F.slice("words", F.col("at"), F.lit(n)), " ") for n in (1, 2, 3)])).alias("window"))
    rows = rows.where(F.lower("window").rlike(KEYWORDS)).distinct().withColumns({"header": norm_header("window"), "bare": bare_header("window")})
    forms = rows.select("doc_id", "page", "window", F.explode(F.array_distinct(key_forms("header", "bare"))).alias("key"))
    keys = F.broadcast(synonym_dimension(all_pages.sparkSession))  # 30 fixed rows
    named = forms.join(keys, "key").groupBy("doc_id", "page", "window").agg(F.min_by("domain", "rank").alias("domain"))
    found = named.groupBy("doc_id", "page").agg(F.collect_set("domain").alias("domains"))
    some = lambda names: F.arrays_overlap("domains", F.array(*map(F.lit, names)))
    return found.where((F.size("domains") >= 3) & some(V.STRUCTURE) & some(V.RESULTS)).select("doc_id", "page")


def own_grams(all_pages: DataFrame) -> DataFrame:
    """doc_id, page, gram: character runs that one page alone of its document has."""
    grams = all_pages.select("doc_id", "page", F.explode("grams").alias("gram"))
    return grams.groupBy("doc_id", "gram").agg(F.min("page").alias("page"), F.count("*").alias("n")).where("n = 1").select("doc_id", "page", "gram")


def uncovered_pages(texts: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id, pages (of page and recall; ascending, at most four) of documents with any.

    texts: doc_id, sourceText. extracted: doc_id, extracted. A page counts if it is long enough,
    holds a grid, and has enough wording of its own; it is flagged if too little of that came back.
    """
    found = pages(texts)
    gated = grid_pages(found.where(F.length(strip("text")) >= V.PAGE_LEAST))
    looked_at = gated.select("doc_id").distinct()
    found = found.join(looked_at, "doc_id").withColumn("flat", folded("text")).withColumn("grams", char_grams("flat", folded=True))
    own = own_grams(found).join(gated, ["doc_id", "page"])
    claimed = extracted.join(looked_at, "doc_id").select("doc_id", folded("extracted").alias("flat"))
    claimed = claimed.select("doc_id", F.explode(char_grams("flat", folded=True)).alias("gram"), F.lit(1).alias("hit"))
    own = own.join(claimed.select("doc_id").distinct(), "doc_id", "left_semi").join(claimed, ["doc_id", "gram"], "left")
    recall = own.groupBy("doc_id", "page").agg(F.count("*").alias("own"), (F.count("hit") / F.count("*")).alias("recall"))
    bad = recall.where((F.col("own") >= V.GRAMS_LEAST) & (F.col("recall") < V.COVERED))
    return bad.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("page", "recall"))), 1, V.PAGES_MOST).alias("pages"))


def named_pages(numbers: Column) -> Column:
    """page 3 / pages 3, 5 and 6."""
    n = F.size(numbers)
    texts = F.transform(numbers, lambda p: p.cast("string"))
    many = F.concat(F.lit("pages "), F.array_join(F.slice(texts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.try_element_at(texts, n))
    return F.when(n == 0, F.lit("")).when(n == 1, F.concat(F.lit("page "), F.try_element_at(texts, F.lit(1)))).otherwise(many)
