"""Between the two forms of a grid: nested, a row per document, and items, a row per item.

The long form has doc_id, domain, domain_ord, group_ord, group_name, item_ord, text and the item's
other attributes. Unnesting needs no shuffle; every later step on items keeps doc_id as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.headers import label_of
from ..functions.text import is_blank, not_blank, strip
from ..sources.schema import GROUP, ITEM

EMPTY = f"cast(array() as array<{GROUP.simpleString()}>)"
ATTRIBUTES = [f.name for f in ITEM.fields if f.name != "text"]


def groups_of(domain: str) -> Column:
    """Groups of a column of the grid; none where it is absent."""
    return F.coalesce(F.col(f"{domain}.content"), F.expr(EMPTY))


def items(models: DataFrame, domains: tuple[str, ...] = V.GROUPED, blank: bool = False) -> DataFrame:
    """The long form, blank items left out unless asked for. Texts stay untrimmed."""
    per_domain = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(V.GROUPED.index(d)).alias("domain_ord"), groups_of(d).alias("groups")) for d in domains])
    rows = models.select("doc_id", F.explode(per_domain).alias("d"))
    rows = rows.select("doc_id", "d.domain", "d.domain_ord", F.posexplode("d.groups").alias("group_ord", "g"))
    rows = rows.select("doc_id", "domain", "domain_ord", "group_ord", F.col("g.name").alias("group_name"), F.posexplode("g.items").alias("item_ord", "item"))
    rows = rows.select("doc_id", "domain", "domain_ord", "group_ord", "group_name", "item_ord", "item.*")
    return rows if blank else rows.where(not_blank("text"))


def nest(rows: DataFrame) -> DataFrame:
    """doc_id and one boxed column per domain, from the long form; groups and items in their order."""
    present = [a for a in ATTRIBUTES if a in rows.columns]
    attributes = [F.col(a) if a in present else F.lit(None).cast(ITEM[a].dataType).alias(a) for a in ATTRIBUTES]
    item = F.struct("item_ord", F.struct("text", *attributes).alias("item"))
    groups = rows.groupBy("doc_id", "domain", "group_ord", "group_name").agg(F.array_sort(F.collect_list(item), by("item_ord")).alias("found"))
    group = F.struct("group_ord", F.struct(F.col("group_name").alias("name"), F.transform("found", lambda x: x["item"]).alias("items")).alias("g"))
    one = lambda d: F.array_sort(F.collect_list(F.when(F.col("domain") == d, group)), by("group_ord"))
    boxed = groups.groupBy("doc_id").agg(*[one(d).alias(d) for d in V.GROUPED])
    return boxed.select("doc_id", *[F.struct(F.transform(d, lambda x: x["g"]).alias("content")).alias(d) for d in V.GROUPED])


def by(field: str):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def fields(models: DataFrame) -> DataFrame:
    """doc_id, field, value: the overview and plain texts that are not blank."""
    pairs = [(f, F.col(f"{f}.content")) for f in V.OVERVIEW] + [(f, F.col(f)) for f in (*V.PLAIN, "colorLegend")]
    rows = models.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in pairs])).alias("p")).select("doc_id", "p.*")
    return rows.where(not_blank("value"))


def find_items(models: DataFrame, domain: str) -> DataFrame:
    """doc_id, group_name, text of one domain; an overview field is one General row."""
    if domain in V.OVERVIEW:
        return models.where(not_blank(f"{domain}.content")).select("doc_id", F.lit("General").alias("group_name"), F.col(f"{domain}.content").alias("text"))
    return items(models, (domain,)).select("doc_id", "group_name", "text")


def extracted_text(models: DataFrame) -> DataFrame:
    """doc_id, extracted: all wording that a model claims, joined by line breaks."""
    parts = F.flatten(
        F.array(*[F.flatten(F.transform(groups_of(d), lambda g: F.concat(F.array(g["name"]), F.transform(g["items"], lambda i: i["text"])))) for d in V.GROUPED])
    )
    texts = F.array(*[F.col(f"{f}.content") for f in V.OVERVIEW], *[F.col(f) for f in (*V.PLAIN, "colorLegend")])
    kept = F.concat(F.filter(parts, lambda p: p.isNotNull() & (p != "")), F.filter(texts, not_blank))
    return models.select("doc_id", F.array_join(kept, "\n").alias("extracted"))


def granular(models: DataFrame) -> DataFrame:
    """One row per overview field and item with content, labelled, in reading order (ord)."""
    long = items(models).select(
        "doc_id", "domain", (F.col("domain_ord") + 3).alias("domain_ord"), "group_ord", "group_name", "item_ord", strip("text").alias("content"),
        *[a for a in ATTRIBUTES],
    )
    pairs = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(i).alias("domain_ord"), F.col(f"{d}.content").alias("content")) for i, d in enumerate(V.OVERVIEW)])
    flat = models.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*").where(not_blank("content"))
    flat = flat.select("doc_id", "domain", "domain_ord", F.lit(None).cast("int").alias("group_ord"), F.lit("General").alias("group_name"), F.lit(None).cast("int").alias("item_ord"), "content")
    return flat.unionByName(long, allowMissingColumns=True).withColumn("domain_label", label_of("domain"))


def first_by_text(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Of each (doc_id, text without case) the first item in a preferred order of domains."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("domain"))
    w = Window.partitionBy("doc_id", F.lower(strip("text"))).orderBy(rank, "group_ord", "item_ord")
    return rows.where(rank > 0).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def counts(rows: DataFrame) -> DataFrame:
    """doc_id, total, grid, unmapped: items that are not blank."""
    return rows.where(not_blank("text")).groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("domain") != V.UNMAPPED).alias("grid"), F.count_if(F.col("domain") == V.UNMAPPED).alias("unmapped")
    )


def needs_review(rows: DataFrame) -> DataFrame:
    """Items marked as not verbatim, or with a note."""
    return rows.where((F.coalesce(F.col("verbatim") == F.lit(False), F.lit(False))) | ~is_blank("sourceNote"))
