"""Exact length histogram: from one row per encoded length, suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, load
from .tokens import encoder, slices

#: Lengths of one step of the two-level sums.
STEP = 128


def encoded_lengths(docs: DataFrame, file: str, extra: int = 0) -> DataFrame:
    """One row (n_tokens) per document: ids of its whole text, however long, plus ``extra``. A null text has none."""

    def count(batches):
        enc = encoder(file)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(enc.encode(texts[a:b])[1] + extra, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs, with all documents counted exactly.

    lengths: rows (n_tokens). Returns n_tokens (L), n_docs, tokens (of those documents),
    docs_longer (length over L), docs_up_to, tokens_up_to (length L or less), tokens_longer,
    truncated_total (tokens left when every document is cut to L), quantile (share of documents of
    length L or less). A limit between two lengths behaves as the next lower one, plus docs_longer
    tokens for each step above it. An empty table gives an empty result; null lengths count as 0.
    """
    by_length = lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    by_length = cut(by_length.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("step", F.floor(F.col("n_tokens") / STEP)))
    after = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = by_length.groupBy("step").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))  # a row for each STEP lengths
    zero, all_ = F.lit(0).cast("long"), Window.partitionBy()
    steps = steps.select("step", F.sum("d").over(all_).alias("all_docs"), F.sum("t").over(all_).alias("all_tokens"), F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"))
    within = Window.partitionBy("step").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = by_length.join(steps, "step").withColumns(
        {
            "docs_longer": F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), zero),
            "tokens_longer": F.col("t_after") + F.coalesce(F.sum("tokens").over(within), zero),
        }
    )
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_up_to"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed: one row."""
    return hist.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to ``limit``: one row."""
    return hist.agg(F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("tokens"))


def op6_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(encoded_lengths(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), extra=1))
