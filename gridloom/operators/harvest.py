"""The impact statement under its heading in a text: Column -> Column, in one pass over its stop words.

The text is cut at its stop words into stretches between them; one fold carries from stretch to stretch whether lower-case
prose stands since the last sentence end, so no stretch is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import let, squeeze, strip_markup

#: The edge of a word of ASCII letters, digits and underscores, in any version of the engine's pattern language.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SENTENCE_END = "[.!?][\"'“”)\\]*_~`]*\\s+"
LOWER = "[a-z]"


def words(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", EDGE)


HEADING, STOPS, PEOPLE, CHANGE = map(words, (V.STATEMENT_HEADING, V.STATEMENT_STOPS, V.POPULATION, V.CHANGE))


def reads_as_list(s: Column) -> Column:
    """Two list markers or two bold spans."""
    return (F.regexp_count(s, F.lit(r"(?:^|\s)(?:[-•*]\s+|\d+[.)]\s+)")) >= 2) | (F.regexp_count(s, F.lit(r"\*\*[^*]+\*\*")) >= 2)


def fits(s: Column) -> Column:
    return F.length(s).between(V.STATEMENT_LEAST, V.STATEMENT_MOST)


def is_statement(s: Column) -> Column:
    """80 to 600 characters of prose about people and a change."""
    return fits(s) & ~s.rlike(r"^(?:[-•*]|\d+[.)])") & ~reads_as_list(s) & s.rlike(PEOPLE) & s.rlike(CHANGE)


def stop_at(body: Column) -> Column:
    """Characters before the next heading: a stop word that only capitals lead up to since a sentence end. Null without one."""
    stops = F.regexp_extract_all(body, F.lit(STOPS), F.lit(0))
    stretches = F.zip_with(F.split(body, STOPS, -1), stops, lambda p, s: F.struct(p.alias("text"), F.coalesce(s, F.lit("")).alias("stop")))
    state = lambda found, prose, at: F.struct(found.alias("found"), prose.alias("prose"), at.alias("at"))

    def step(acc: Column, x: Column) -> Column:
        tail = F.regexp_replace(x["text"], f"(?s)^.*{SENTENCE_END}", "")
        prose = F.when(x["text"].rlike(SENTENCE_END), tail.rlike(LOWER)).otherwise(acc["prose"] | x["text"].rlike(LOWER))
        here = acc["at"] + F.length(x["text"])
        stands = state(F.lit(True), F.lit(False), here)
        goes_on = state(F.lit(False), prose | x["stop"].rlike(LOWER), here + F.length(x["stop"]))
        return F.when(acc["found"], acc).when(~prose & (x["stop"] != ""), stands).otherwise(goes_on)

    return F.aggregate(stretches, state(F.lit(False), F.lit(False), F.lit(0)), step, lambda acc: F.when(acc["found"], acc["at"]))


def statement_after(rest: Column) -> Column:
    """The text after a heading up to the next one, without the first word that a longer heading leaves behind the last sentence."""

    def ended(body: Column) -> Column:
        cut = lambda at: F.when(at.isNull(), body).otherwise(F.regexp_replace(F.substring(body, F.lit(1), at), r"([.!?][\"'“”)]*)\s+\S+\s*\z", "$1"))
        return let(stop_at(body), cut)

    body = let(F.regexp_replace(rest, r"^[:\-–—\s]+", ""), ended)
    return F.trim(F.regexp_replace(squeeze(body), "^[\"'“”]+|[\"'“”]+\\z", ""))


def labelled_statement(text: Column) -> Column:
    """The impact statement under its heading: the slice up to the next heading, or else the first sentence after the heading
    that reads as one. Null for a null text, and without a heading or a statement."""

    def after(rest: Column) -> Column:
        found = F.regexp_extract_all(rest, F.lit("[^.!?]+[.!?]+"), F.lit(0))
        sentences = F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(rest)), squeeze)
        body = let(statement_after(rest), lambda s: F.when(fits(s) & ~reads_as_list(s), s))
        return strip_markup(F.coalesce(body, F.get(F.filter(sentences, is_statement), F.lit(0))))

    parts = F.split(squeeze(text), HEADING, 2)
    return let(parts, lambda p: F.when(F.size(p) == 2, after(F.get(p, F.lit(1)))))
