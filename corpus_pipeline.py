"""The corpus pipeline: clean, near-deduplicate, redact, mix and pack the documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; run() writes each result as Parquet and reads it back as the next stage's docs. All stages
but the last return the columns of documents, whatever further columns there are and however they are named.

An empty table stays empty in every stage. Null texts count as empty: quality drops them, so that later
stages meet them only if run on their own, and then keep them (near_duplicates, secrets), take nothing
of them (mixing) or pack their end id alone (packing). Null ids, sources and other columns are values
like any other. Texts of any length are read whole.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import load, materialize, small_batches
from gridloom.llm.jaccard import keep_one
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.packing import pack_along_curve
from gridloom.llm.quality import keep_clean
from gridloom.llm.secretscan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the quality rules reject. Repeated rows are judged alike; a line that
    fails several rules goes once."""
    small_batches(spark)
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of equal rows one, and of texts that
    tie on the id that of the least hash. Documents without words stay."""
    small_batches(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, overlapping ones by one mark; every document stays, repeated rows too."""
    small_batches(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights, in blocks of words; a row for each pass over a document. Repeated rows are
    documents of their own; documents whose hashes tie follow each other by id, size and row."""
    small_batches(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed along the Hilbert curve into sequences of 2048 ids; pieces keep their ids and their row. Equal
    keys of the curve follow each other by id and row; repeated rows are packed once each."""
    small_batches(spark)
    return pack_along_curve(docs, vocabulary("word_bpe_49k.json"), with_ids=True, with_row=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Tokenizing and the mix's permutations are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
