"""Line-first cleaning: rules judge each line, failing lines go, then a document that loses too much goes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import drop_worker_caches, load, words_of

#: A document is rejected when its kept lines hold less than this share of its word characters.
LEAST_KEPT = 0.5
#: Symbols per word above which a line is noise; separators per word above which it is navigation.
SYMBOLS_PER_WORD, SEPARATORS_PER_WORD = 0.5, 0.2

SYMBOLS = "#*$%&|<>"
SEPARATOR = re.compile("[|»›•·]|->|::")
#: Marks that end a sentence or open a list, in the scripts that have marks of their own.
TERMINAL = re.compile("[.!?…:;。！？．：；｡։؟؛۔।॥။።፧៕᠃᠉][\"'’”»)\\]）」』】]*$")
#: Phrases of licence, consent, account and sharing lines.
BOILERPLATE = re.compile(
    r"all rights reserved|(licen[sc]ed|released|distributed) under (the|a|cc|an)\b|privacy policy|cookie policy|accept (all )?cookies|uses? cookies"
    r"|terms (of|and) (use|service|conditions)|copyright (\(c\)|©|\d{4})|enable javascript|lorem ipsum|sign (in|up) (to|for|with)|log in to"
    r"|subscribe to (our|the)|click here|read more|share (this|on) |follow us|back to top|skip to content|powered by "
    r"|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|tous droits r[ée]serv|politique de confidentialit|conditions d.utilisation"
    r"|todos los derechos reservados|pol[íi]tica de (privacidad|cookies)|t[ée]rminos (y condiciones|de (uso|servicio))",
    re.IGNORECASE,
)
RULES = ("punctuation", "navigation", "symbols", "shouting", "boilerplate", "repeated")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str]) -> int:
    """Words inside a window of three words that occurs at least twice in the text."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    pair = code[:-1] * v + code[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * v + code[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def failing_rule(line: str, words: list[str], n_symbols: int, repeated: bool) -> str | None:
    """The first rule that a line with words fails, or None."""
    if repeated:
        return "repeated"
    n = len(words)
    separators = len(SEPARATOR.findall(line)) if not line.isalnum() else 0
    if separators >= 1 and separators > SEPARATORS_PER_WORD * n:
        return "navigation"
    if n_symbols > SYMBOLS_PER_WORD * n:
        return "symbols"
    if n >= 3 and line.isupper() or "!!" in line:
        return "shouting"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if not TERMINAL.search(line.rstrip()):
        return "punctuation"
    return None


def judge(text: str | None) -> tuple:
    """(stats..., base_failed, kept, failed lines by rule, cleaned text) of a text."""
    failed = dict.fromkeys(RULES, 0)
    seen: set[str] = set()
    all_words: list[str] = []
    out: list[str] = []
    chars = symbols = dups = left = 0
    for line in (text or "").split("\n"):
        words = words_of(line)
        if not words:
            out.append(line)
            continue
        n_symbols = sum(map(line.count, SYMBOLS))
        size = sum(map(len, words))
        repeated = line in seen
        seen.add(line)
        all_words += words
        chars += size
        symbols += n_symbols
        dups += repeated
        rule = failing_rule(line, words, n_symbols, repeated)
        if rule:
            failed[rule] += 1
        else:
            out.append(line)
            left += size
    n, repeat = len(all_words), repeated_words(all_words)
    base_failed = n < 50 or 100 * repeat > 50 * n
    return n, chars, symbols, dups, repeat, base_failed, not base_failed and left >= LEAST_KEPT * chars, *failed.values(), "\n".join(out)


COLUMNS = [*STATS, "base_failed", "kept", *[f"lines_{r}" for r in RULES], "clean_text"]
TYPES = ["long"] * 5 + ["boolean"] * 2 + ["long"] * len(RULES) + ["string"]


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Judge every document of ``docs`` (doc_id, text, and any other columns, which are ignored).

    Returns doc_id; n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text;
    base_failed; kept; failed lines by rule; and with_text the text without its failing lines. Lines
    without words are neither judged nor removed. A null or empty text has no words and is rejected.
    Whole texts are judged, however long; a line that fails several rules (a tie) counts for the first of
    them. Repeated rows are judged each on its own; an empty table gives an empty result. No shuffle.
    """
    width = len(COLUMNS) - (not with_text)
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[t] for t in TYPES]

    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows = [judge(t)[:width] for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 256), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *COLUMNS[:width]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in zip(COLUMNS[:width], TYPES)))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines: same columns, whatever their names, n_chars to fit if
    present. Null and empty texts go; repeated rows are judged each on its own; an empty table stays empty. No shuffle."""
    kinds, names = docs.schema, docs.columns

    def run(batches):
        drop_worker_caches()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                judged = [judge(t) for t in part.column(names.index("text")).to_pylist()]
                part = part.filter(pa.array([j[6] for j in judged], pa.bool_()))
                texts = [j[-1] for j in judged if j[6]]
                new = {"text": pa.array(texts, pa.string()), "n_chars": [len(t) for t in texts]}
                columns = [pa.array(new[c], part.schema.field(i).type) if c in new else part.column(i) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, kinds)


def op7_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(load(spark, sf_dir, "documents"), with_text=False)
