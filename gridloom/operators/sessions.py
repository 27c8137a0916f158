"""Sessions of files: what is flagged and why, checkpoints, captures and replays, and what a run comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.cells import split_cell
from ..functions.labels import display_name, name_list, record_hash
from ..functions.text import norm_match, seed
from .fidelity import banner, signals
from .items import fields, items


def is_ready(status: Column) -> Column:
    return F.coalesce(status.isin(*V.READY), F.lit(False))


def is_busy(status: Column) -> Column:
    return F.coalesce(status.isin(*V.BUSY), F.lit(False))


def flagged(files: DataFrame, models: DataFrame) -> DataFrame:
    """doc_id, status, bucket (flagged, ready, busy, queued; flagged wins), reason, summary of each file.

    files: doc_id, status, error, blockers. A file may have no model.
    """
    m = signals(models).select("doc_id", F.lit(True).alias("has"), (banner(F.col("extractionStatus"), F.col("extractionConfidence")) | F.col("s_mismatch")).alias("needs"), "s_mismatch", F.try_element_at("extractionBlockers", F.lit(1)).alias("own"), "extractionConfidence", "s_n")
    rows = files.join(m, "doc_id", "left")
    error, has = F.col("status") == "error", F.coalesce("has", F.lit(False))
    flag = error | (has & is_ready(F.col("status")) & F.coalesce("needs", F.lit(False)))
    some = lambda c: F.nullif(c, F.lit(""))
    failed = F.coalesce(some(F.try_element_at("blockers", F.lit(1))), some(F.col("error")), F.lit(V.FLAG_UNKNOWN))
    why = F.when(error, failed).when(~has, V.FLAG_UNKNOWN).when(F.col("s_mismatch"), V.FLAG_MISMATCH).otherwise(F.coalesce(some(F.col("own")), F.lit(V.FLAG_OTHER)))
    count = F.concat(F.col("s_n").cast("string"), F.when(F.col("s_n") == 1, " item").otherwise(" items"))
    trust = F.coalesce(F.concat(F.lit(" · "), some(F.col("extractionConfidence")), F.lit(" confidence")), F.lit(""))
    bucket = F.when(flag, "flagged").when(is_ready(F.col("status")), "ready").when(is_busy(F.col("status")), "busy").otherwise("queued")
    return rows.select("doc_id", "status", bucket.alias("bucket"), F.when(flag, why).alias("reason"), F.when(has, F.concat(count, trust)).otherwise("").alias("summary"))


def omits_files(counts: DataFrame) -> DataFrame:
    """Whether an export would leave files out. counts: ready and total."""
    return counts.select("*", (F.col("ready") < F.col("total")).alias("omits"))


def checkpoints(files: DataFrame) -> DataFrame:
    """Files as they are kept between sessions: work in progress starts anew; record_key changes with any column."""
    kept = files.withColumn("status", F.when(is_busy(F.col("status")), "pending").otherwise(F.col("status")))
    return kept.withColumn("record_key", record_hash(*kept.columns))


def restored(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Records with their content: their own, or the blob that split siblings share; those without any are left out.

    records: source_document_id, content; blobs: id, content, one row per id.
    """
    shared = blobs.select(F.col("id").alias("source_document_id"), F.col("content").alias("shared"))
    rows = records.join(shared, "source_document_id", "left").withColumn("content", F.coalesce("content", "shared")).drop("shared")
    return rows.where("content is not null").select(*records.columns)


def saved(stored: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored records with newer ones in their place. One record per key on either side."""
    return stored.join(records.select(key), key, "left_anti").unionByName(records)


def deleted(records: DataFrame, blobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, blobs) without the records of gone (doc_id); a blob goes with the last record that shares it."""
    left = records.join(gone.select("doc_id"), "doc_id", "left_anti")
    lost = records.join(gone.select("doc_id"), "doc_id", "left_semi").select(F.col("source_document_id").alias("id")).where("id is not null").distinct()
    lost = lost.join(left.select(F.col("source_document_id").alias("id")), "id", "left_anti")
    return left, blobs.join(lost, "id", "left_anti")


def capture_keys(files: DataFrame) -> DataFrame:
    """files with capture_key: the name that is shown, else the format."""
    return files.withColumn("capture_key", F.coalesce(display_name("file_name", "split_part_label"), F.col("sourceFormat")))


def complete_captures(bundles: DataFrame, answers: DataFrame) -> DataFrame:
    """capture_key of captures with both halves, in order."""
    return bundles.select("capture_key").distinct().join(answers.select("capture_key"), "capture_key", "left_semi").orderBy("capture_key")


def replays(bundles: DataFrame, dumps: DataFrame) -> DataFrame:
    """Dumped answers with the document that they belong to: both sides know the seed of the bundle's text and images.

    bundles: doc_id, textTrack, images. dumps: seed and the answer's columns.
    """
    image_texts = F.concat(F.array(F.coalesce("textTrack", F.lit(""))), F.coalesce("images", F.expr("cast(array() as array<string>)")))
    joined = F.array_join(F.filter(image_texts, lambda p: p != ""), "\0")
    return bundles.select("doc_id", seed(joined).alias("seed")).join(dumps, "seed")


def regression(tally: DataFrame) -> DataFrame:
    """tally with exit_code and outcome, the first rule that holds. tally: unchanged, changed, missing_bundles, failures,
    unblessed, update, require_bundles."""
    c = F.col
    measured = c("unchanged") + c("changed")
    produced = measured + c("unblessed")
    text = lambda n: n.cast("string")
    rules = [
        (c("failures") > 0, 2, F.concat(text(c("failures")), F.lit(" document(s) errored"))),
        ((produced == 0) & (c("missing_bundles") > 0), 2, F.concat(F.lit("Nothing was tested: all "), text(c("missing_bundles")), F.lit(" document(s) in scope have no captured bundle"))),
        (produced == 0, 2, F.lit("Nothing was tested: no document in scope produced a result")),
        (c("require_bundles") & (c("missing_bundles") > 0), 2, F.concat(text(c("missing_bundles")), F.lit(" document(s) have no captured bundle"))),
        ((c("unblessed") > 0) & ~c("update"), 1, F.concat(text(c("unblessed")), F.lit(" document(s) ran with no committed snapshot"))),
        ((c("changed") > 0) & ~c("update"), 1, F.lit("Output changed")),
    ]
    code, told = F.lit(0), F.when(c("update"), F.concat(text(produced), F.lit(" document(s) measured, baselines accepted"))).otherwise(F.concat(text(measured), F.lit(" document(s) measured, all unchanged")))
    for holds, number, line in reversed(rules):
        code, told = F.when(holds, F.lit(number)).otherwise(code), F.when(holds, line).otherwise(told)
    return tally.withColumns({"exit_code": code, "outcome": told})


def split_survey(models: DataFrame) -> DataFrame:
    """items, cells_split, parts, documents: what the splitter of run-on cells does to all grids; one row."""
    rows = items(models, V.GRID).select("doc_id", F.size(split_cell(F.col("text"))).alias("n"))
    some = F.col("n") > 0
    return rows.agg(F.count("*").alias("items"), F.count_if(some).alias("cells_split"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("parts"), F.count_distinct(F.when(some, F.col("doc_id"))).alias("documents"))


def sought(models: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, domain, group_name, text, found: whether the wording of each item and overview field stands in the document's text.

    texts: doc_id, sourceText, one row per document; a document without a row or text has an empty one. Each text is normalized once and stays
    in one row: a document's wordings are gathered and brought to it, not the text to each of them.
    """
    overview = fields(models).where(F.col("field").isin(*V.OVERVIEW)).select("doc_id", F.col("field").alias("domain"), F.lit(None).cast("string").alias("group_name"), F.col("value").alias("text"))
    rows = items(models).select("doc_id", "domain", "group_name", "text").unionByName(overview)
    wordings = rows.groupBy("doc_id").agg(F.collect_list(F.struct("domain", "group_name", "text", norm_match("text").alias("needle"))).alias("w"))
    flat = texts.select("doc_id", norm_match(F.coalesce("sourceText", F.lit(""))).alias("hay"))
    both = wordings.join(flat, "doc_id", "left").withColumn("hay", F.coalesce("hay", F.lit("")))
    tested = F.transform("w", lambda x: F.struct(x["domain"].alias("domain"), x["group_name"].alias("group_name"), x["text"].alias("text"), F.contains(F.col("hay"), x["needle"]).alias("found")))
    return both.select("doc_id", F.explode(tested).alias("x")).select("doc_id", "x.*")


def findable(models: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, n_items, n_found: wordings of each document, and how many of them stand in its text."""
    return sought(models, texts).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if("found").alias("n_found"))


def batch_outcome(files: DataFrame) -> DataFrame:
    """message of a batch of prints: one row; null if none was left out. files: ord, name, outcome (drawn, empty, failed).

    Of the files left out only the first five of each kind come together, for a reader, with how many more there are."""
    ranked = files.where(F.col("outcome").isin("empty", "failed")).withColumn("r", F.row_number().over(Window.partitionBy("outcome").orderBy("ord", "name"))).where(F.col("r") <= V.NAMES_MOST)
    shown = ranked.groupBy().agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.struct("r", "name")))), lambda x: x["name"]).alias(kind) for kind in ("empty", "failed")])
    count = files.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == kind).alias(f"n_{kind}") for kind in ("empty", "failed")])
    all_ = count.withColumn("one", F.lit(1)).join(shown.withColumn("one", F.lit(1)), "one")  # a row on either side
    omitted = F.col("n_empty") + F.col("n_failed")
    part = lambda c, one, many, end: F.when(F.col(f"n_{c}") > 0, F.concat(F.col(f"n_{c}").cast("string"), F.when(F.col(f"n_{c}") == 1, one).otherwise(many), F.lit(end), name_list(F.col(c), F.col(f"n_{c}")), F.lit(".")))
    head = F.when(omitted >= F.col("total"), "Couldn't create the batch ZIP.").otherwise(F.format_string("Downloaded %d of %d PDFs.", F.col("total") - omitted, "total"))
    text = F.concat_ws(" ", head, part("empty", " file had", " files had", " nothing to put in a PDF: "), part("failed", " file couldn't", " files couldn't", " be drawn: "))
    return all_.select(F.when(omitted > 0, text).alias("message"))
