"""Wording that stands elsewhere word for word: anti-joins and homes, on normalized text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text, not_blank


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line, of the lines that are not blank. No shuffle."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(not_blank("line"))


def keyed(rows: DataFrame, text: str = "line") -> DataFrame:
    return rows.withColumn("same", norm_text(text))


def short(rows: DataFrame) -> DataFrame:
    """Rows with a 128-bit digest of the key in its place: shuffles carry 16 bytes, however long the lines are."""
    return rows.withColumn("same", F.unhex(F.md5("same")))


def homes(rows: DataFrame) -> DataFrame:
    """same, home_doc, home_line: the first place of each key. rows: doc_id, line_no, same.

    Partial minima before the shuffle, so a key that fills a third of the rows costs a row a task.
    """
    return rows.groupBy("same").agg(F.min(F.struct("doc_id", "line_no")).alias("home")).select("same", F.col("home.doc_id").alias("home_doc"), F.col("home.line_no").alias("home_line"))


def restated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, home_doc, home_line: the lines that an earlier document has."""
    rows = short(keyed(lines(docs))).select("doc_id", "line_no", "same")
    first = rows.groupBy("doc_id", "same").agg(F.min("line_no").alias("line_no"))
    places = first.join(homes(first), "same").where("home_doc < doc_id").select("doc_id", "same", "home_doc", "home_line")
    return rows.join(places, ["doc_id", "same"]).select("doc_id", "line_no", "home_doc", "home_line")


def restated_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_restated, n_left of each document with a line."""
    rows = short(keyed(lines(docs))).groupBy("doc_id", "same").agg(F.count("*").alias("n"))
    home = rows.groupBy("same").agg(F.min("doc_id").alias("home_doc"))
    old = F.col("home_doc") < F.col("doc_id")
    return rows.join(home, "same").groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"), F.sum(F.when(old, F.col("n")).otherwise(0)).alias("n_restated"), F.sum(F.when(old, 0).otherwise(F.col("n"))).alias("n_left")
    )
