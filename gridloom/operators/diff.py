"""Multiset comparisons of two long tables of items (doc_id, domain, group_name, ord, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, not_blank

PLACE = ["doc_id", "same", "domain", "group_name"]


def keyed(items: DataFrame) -> DataFrame:
    return items.where(not_blank("text")).select("doc_id", "domain", F.coalesce("group_name", F.lit("General")).alias("group_name"), "ord", F.trim("text").alias("text"), norm_text("text").alias("same"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, change (added, removed, moved), text, from_domain, from_group, to_domain, to_group.

    Equal places cancel one for one (from the end before, from the front after); what is left of a
    text pairs up first in, first out as moves; the rest was added or removed. A text is shown as at
    its first occurrence on the side it comes from.
    """

    def side(items: DataFrame, order: Column) -> DataFrame:
        rows = keyed(items)
        shown = F.min(F.struct("ord", "text")).over(Window.partitionBy("doc_id", "same"))["text"]
        return rows.withColumns({"shown": shown, "copy": F.row_number().over(Window.partitionBy(*PLACE).orderBy(order))})

    def left(mine: DataFrame, other: DataFrame) -> DataFrame:
        rest = mine.join(other.select(*PLACE, "copy"), [*PLACE, "copy"], "left_anti")
        return rest.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("ord")))

    b, a = side(before, F.desc("ord")), side(after, F.asc("ord"))
    old = left(b, a).select("doc_id", "same", "turn", F.col("domain").alias("from_domain"), F.col("group_name").alias("from_group"), F.col("shown").alias("old_text"))
    new = left(a, b).select("doc_id", "same", "turn", F.col("domain").alias("to_domain"), F.col("group_name").alias("to_group"), F.col("shown").alias("new_text"))
    both = old.join(new, ["doc_id", "same", "turn"], "full_outer")
    change = F.when(F.col("from_domain").isNull(), "added").when(F.col("to_domain").isNull(), "removed").otherwise("moved")
    return both.select("doc_id", change.alias("change"), F.coalesce("old_text", "new_text").alias("text"), "from_domain", "from_group", "to_domain", "to_group")


def count_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, group_name, text, n_left, n_right where the two sides do not hold a text as often."""
    count = lambda rows, name: rows.where(not_blank("text")).groupBy("doc_id", "group_name", F.trim("text").alias("text")).agg(F.count("*").alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), ["doc_id", "group_name", "text"], "full_outer").fillna(0, ["n_left", "n_right"])
    return both.where("n_left <> n_right")
