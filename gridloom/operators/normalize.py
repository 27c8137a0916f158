"""The normalization pipeline: shape fixes that never move an item to another column.

All passes run over the long form, dealt out by document once; documents are then nested again.
Their order matters; applying the whole twice changes nothing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.cells import label_of_item, split_cell, trim_colons
from ..functions.headers import column_domain, column_of, is_input_subbucket, synonym_of
from ..functions.text import bare_header, is_blank, norm_header, norm_text, not_blank, strip
from . import fidelity
from .harvest import labelled_statement
from .items import EMPTY, items, nest

def in_grid() -> Column:
    return F.col("domain") != V.UNMAPPED


def promote_labels(rows: DataFrame) -> DataFrame:
    """An ungrouped column of mostly 'Label: rest' items becomes one group per label; the items
    without one gather in General where the first of them stood. Adds part_ord, of the new groups."""
    ungrouped = in_grid() & F.lower(strip(F.coalesce("group_name", F.lit("")))).isin("", "general")
    rows = rows.withColumn("tag", F.when(ungrouped, label_of_item(F.coalesce("text", F.lit("")))))
    tagged, within = F.col("tag").isNotNull(), Window.partitionBy("doc_id", "domain", "group_ord")
    rows = rows.withColumn("stays", F.when(tagged, F.coalesce(column_domain("tag.label") == F.col("domain"), F.lit(True))))
    labels = F.count_if(tagged).over(within)
    distinct = F.size(F.collect_set(F.lower("tag.label")).over(within)) == labels
    regroup = (labels >= V.MIN_LABELLED) & (2 * labels >= F.count("*").over(within)) & distinct & F.min("stays").over(within)
    rows = rows.withColumns({"regroup": F.coalesce(regroup, F.lit(False)), "first": F.min(F.when(~tagged, F.col("item_ord"))).over(within)})
    on = F.col("regroup")
    return rows.withColumns(
        {
            "part_ord": F.when(on & tagged, F.col("item_ord")).when(on, F.col("first")).otherwise(0),
            "group_name": F.when(on, F.coalesce("tag.label", F.lit("General"))).otherwise(F.col("group_name")),
            "text": F.when(on & tagged, F.col("tag.rest")).otherwise(F.col("text")),
        }
    ).drop("tag", "stays", "regroup", "first")


def trim_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("group_name", trim_colons(F.col("group_name")))


def split_items(rows: DataFrame) -> DataFrame:
    """Run-on cells of the grid become one item per part, with their parent's attributes."""
    parts = F.coalesce(F.when(in_grid(), split_cell(F.col("text"))), F.array("text"))  # exploded as it is: a column of its own would be computed for a filter too
    rest = [c for c in rows.columns if c not in ("text", "item_ord")]
    rows = rows.select(*rest, "item_ord", F.posexplode(parts).alias("piece_ord", "text"))
    return rows.withColumn("item_ord", F.struct("item_ord", "piece_ord")).drop("piece_ord")


def map_headers(rows: DataFrame) -> DataFrame:
    """Items get their group's header, and who placed them and why, where they have none of it."""
    name = F.coalesce(F.nullif(strip("group_name"), F.lit("")), F.lit("General"))
    rows = rows.withColumn("group_name", F.when(in_grid(), name).otherwise(F.col("group_name")))
    rows = rows.withColumns({"header": norm_header("group_name"), "bare": bare_header("group_name")})
    rows = rows.withColumns({"strict": column_of("bare"), "loose": synonym_of("header", "bare")})
    other = F.coalesce(F.col("strict") != F.col("domain"), F.lit(False))
    own = F.coalesce(F.col("loose") == F.col("domain"), F.lit(False))
    bucket = (F.col("domain") == "inputs") & is_input_subbucket("group_name")
    rows = rows.withColumn("why", F.when(~in_grid(), "unmapped").when(other, "spatial").when(own, "synonym").when(bucket, "subbucket").otherwise("spatial"))
    rows = rows.withColumn("shown", F.when(~in_grid() | other | own | bucket | (F.col("group_name") != "General"), strip("group_name")))
    live = ~in_grid() | not_blank("text")  # blank items of the grid stay as they are
    fill = live & not_blank("shown") & is_blank("sourceHeader")
    return rows.withColumns(
        {
            "sourceSection": F.when(fill, F.coalesce(F.nullif(strip("sourceSection"), F.lit("")), "shown")).otherwise(F.col("sourceSection")),
            "sourceHeader": F.when(fill, F.col("shown")).otherwise(F.col("sourceHeader")),
            "mappedBy": F.coalesce("mappedBy", F.when(live & in_grid(), "auto")),
            "mappingConfidence": F.coalesce("mappingConfidence", F.when(live, F.col("why"))),
        }
    ).drop("header", "bare", "strict", "loose", "why", "shown")


def drop_restated(rows: DataFrame) -> DataFrame:
    """Unmapped items that stand in the grid of their document word for word go."""
    rows = rows.withColumn("same", norm_text(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("in_grid", F.max(in_grid()).over(Window.partitionBy("doc_id", "same")))
    return rows.where(in_grid() | (F.col("same") == "") | ~F.col("in_grid")).drop("same", "in_grid")


def reshape(models: DataFrame) -> DataFrame:
    """All passes but the verdicts, over doc_id, the model's columns and optionally sourceText.

    The passes run over items, a row each, dealt out by document once; groups without items vanish.
    """
    out = models
    if "sourceText" in models.columns:
        gap = is_blank("impactStatement.content") & not_blank("sourceText")
        found = F.when(gap, labelled_statement(F.when(gap, F.col("sourceText"))))
        out = out.withColumn("found", found).withColumn("impactStatement", F.when(F.col("found").isNotNull(), F.struct(F.col("found").alias("content"))).otherwise(F.col("impactStatement"))).drop("found")
    rows = items(models, blank=True).repartition("doc_id")
    for step in (promote_labels, trim_names, split_items, map_headers, drop_restated):
        rows = step(rows)
    grids = nest(rows.withColumn("group_ord", F.struct("group_ord", "part_ord")).drop("part_ord"))
    rest = out.drop(*V.GROUPED).withColumn("layoutFamily", F.coalesce(F.nullif("layoutFamily", F.lit("")), F.lit("vertical_columns")))
    rest = rest.withColumn("mappingCorrections", F.coalesce("mappingCorrections", F.array().cast(models.schema["mappingCorrections"].dataType)))
    none = F.struct(F.expr(EMPTY).alias("content"))
    joined = rest.join(grids, "doc_id", "left").withColumns({d: F.coalesce(d, none) for d in V.GROUPED})
    return joined.select(*models.columns)


def normalize(models: DataFrame) -> DataFrame:
    """doc_id, the model's columns, and optionally sourceText, lowLegibility and textOnlyFallback, in;
    the same out, reshaped and with reconciled verdicts. Only documents whose text has page markers
    are looked at page by page. The verdicts read the reshaped rows several times, so these are kept
    (in memory, else on the executors' disks; lost ones are made again)."""
    return fidelity.reconcile(reshape(models).persist(StorageLevel.MEMORY_AND_DISK))
