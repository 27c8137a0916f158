"""Summaries of documents and sessions: colours, stability, states, regressions, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import colour, norm_text, not_blank


def colour_axis(items: DataFrame) -> DataFrame:
    """items: doc_id, domain, fill. doc_id, kind (none, decorative, column_chrome, cross_cutting),
    n_colours, stamped (sorted): what colours mean on a grid."""
    rows = items.select("doc_id", "domain", colour("fill").alias("fill"))
    by_domain = rows.groupBy("doc_id", "domain").agg(F.collect_set("fill").alias("fills"), F.count("fill").alias("coloured"))
    by_doc = by_domain.groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("fills")))).alias("n_colours"), F.max(F.size("fills")).alias("most"),
        F.array_sort(F.collect_list(F.when((F.col("domain") != V.UNMAPPED) & (F.size("fills") == 1) & (F.col("coloured") >= V.STAMPED), F.col("domain")))).alias("stamped"),
    )
    kind = F.when(F.col("n_colours") == 0, "none").when(F.col("n_colours") == 1, "decorative").when(F.col("most") >= 2, "cross_cutting").otherwise("column_chrome")
    return by_doc.select("doc_id", kind.alias("kind"), "n_colours", F.when(kind == "cross_cutting", F.col("stamped")).otherwise(F.expr("cast(array() as array<string>)")).alias("stamped"))


def contents(domain: str = "domain", group_name: str = "group_name", text: str = "text") -> Column:
    """An aggregate over items: a key of their multiset, whatever their order.

    An item is its fields' JSON, in fixed order and without those that are null, hashed by SHA-256; the key sums two
    60-bit parts of the hashes, so that no list of a document's items is gathered. Blank texts are no items; no group
    is the group General."""
    place = F.struct(F.col(domain).alias("domain"), F.coalesce(F.col(group_name), F.lit("General")).alias("group"), norm_text(text).alias("text"))
    digest = F.when(not_blank(text), F.sha2(F.to_json(place), 256))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0))
    return F.struct(part(1).alias("a"), part(16).alias("b"))


def census(runs: DataFrame) -> DataFrame:
    """runs: doc_id, pass, n_items, signature, contents. doc_id, passes, same_count, same_signature, identical, verdict.

    Passes that are identical are stable, whatever the order in which they name their groups."""
    same = lambda c: F.min(c).eqNullSafe(F.max(c))
    out = runs.groupBy("doc_id").agg(F.count("*").alias("passes"), same("n_items").alias("same_count"), same("signature").alias("same_signature"), same("contents").alias("identical"))
    stable = F.col("identical") | (F.col("same_count") & F.col("same_signature"))
    return out.withColumn("verdict", F.when(~stable, "UNSTABLE").when(F.col("passes") >= 3, "STABLE").otherwise("TOO FEW PASSES"))


def state_counts(files: DataFrame) -> DataFrame:
    """ready, running, queued, attention, total, progress over files with a status: one row."""
    c = lambda *names: F.count_if(F.col("status").isin(*names))
    out = files.agg(c("completed", "editing").alias("ready"), c("converting", "detecting", "extracting").alias("running"), c("pending").alias("queued"), c("error").alias("attention"), F.count("*").alias("total"))
    return out.withColumn("progress", F.when(F.col("total") == 0, 0.0).otherwise(F.round((F.col("ready") + F.col("attention")) / F.col("total"), 6)))


def latest_corrections(log: DataFrame) -> DataFrame:
    """log: item_key, at, event_id, to_domain. The last correction of each item and how many it had."""
    return log.groupBy("item_key").agg(F.max_by("to_domain", F.struct("at", "event_id")).alias("to_domain"), F.max("at").alias("at"), F.count("*").alias("n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprint, copies, first_id of each content that several documents have."""
    found = docs.where("text is not null").groupBy(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return found.where("copies > 1")
