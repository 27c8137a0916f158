"""What one cell or one group becomes: run-on splitting and inline labels, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import WS, let, squeeze, strip, word_count

MARK = "\x01"


def balanced(s: Column) -> Column:
    """Brackets close in order and quotes pair up. Only the brackets are walked, where there are any."""
    ok = F.lit(True)
    for opens, closes in (("(", ")"), ("[", "]"), ("{", "}")):
        depth = F.aggregate(
            F.split(F.regexp_replace(s, rf"[^\{opens}\{closes}]+", ""), ""),
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
            lambda acc, ch: F.struct(  # noqa: B023
                (acc["now"] + F.when(ch == opens, 1).otherwise(-1)).alias("now"),  # noqa: B023
                F.least(acc["least"], acc["now"] + F.when(ch == opens, 1).otherwise(-1)).alias("least"),  # noqa: B023
            ),
            lambda acc: (acc["now"] == 0) & (acc["least"] == 0),
        )
        ok = ok & (~(F.contains(s, F.lit(opens)) | F.contains(s, F.lit(closes))) | depth)
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return ok & (count('"') % 2 == 0) & (count("“") == count("”")) & (count("‘") == count("’"))


def spaced(letters: str) -> str:
    """A pattern of a word's letters and stops in either case, with whatever else but those and white space between them."""
    return OTHER.join(rf"\{c}" if c == "." else f"[{c}{c.upper()}]" for c in letters)


SPACE, OTHER = WS[1:-1], f"[^A-Za-z.{WS[1:-1]}]*+"
#: A word whose stop closes a sentence, and the white space up to the capital, bracket or quote that follows: the word has a letter or
#: a stop before its last one, and its letters and stops are neither an initial nor an abbreviation. Decided at the word
#: itself, so that a text is read once however long it is.
SENTENCE_END = (
    rf'(?<![^{SPACE}])(?=[^{SPACE}]++(?<=\.){WS}++[A-Z(“"])(?={OTHER}(?:[A-Za-z]|\.[^{SPACE}]))'
    rf"(?!{OTHER}(?:[A-Z]|{'|'.join(map(spaced, V.ABBREVIATIONS))}){OTHER}\.{WS})([^{SPACE}]++){WS}++"
)


def sentences(s: Column) -> Column:
    """Cut after each sentence stop that white space and a capital, bracket or quote follow; abbreviations and initials go on."""
    marked = F.regexp_replace(F.replace(s, F.lit(MARK), F.lit(MARK + "0")), SENTENCE_END, f"$1{MARK}1")
    return F.filter(F.transform(F.split(marked, MARK + "1"), lambda p: strip(F.replace(p, F.lit(MARK + "0"), F.lit(MARK)))), lambda p: p != "")


def list_parts(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ";"), strip), lambda p: p != "")


def split_cell(text: Column) -> Column:
    """The parts of a run-on cell, or null where it stays as it is.

    Three or more parts between semicolons win; else two or more sentences, each without its stop. Each step reads what the one
    before has computed, once.
    """
    fits = lambda p, words: (F.length(p) <= V.MAX_PART) & (word_count(p) >= words) & balanced(p)

    def listed(parts: Column) -> Column:
        return F.when((F.size(parts) >= V.MIN_LIST_PARTS) & F.forall(parts, lambda p: fits(p, V.MIN_LIST_WORDS) & ~p.rlike(SENTENCE_END)), parts)

    def prose(lines: Column) -> Column:
        bare = F.transform(lines, lambda p: F.regexp_replace(p, r"([^.])\.\z", "$1"))
        return F.when((F.size(lines) >= 2) & F.forall(lines, lambda p: fits(p, V.MIN_SENTENCE_WORDS)), bare)

    def split(t: Column) -> Column:
        eligible = (F.length(t) >= V.MIN_CELL) & ~F.contains(t, F.lit(":")) & balanced(t)
        return F.when(eligible, F.coalesce(F.when(F.contains(t, F.lit(";")), let(list_parts(t), listed)), let(sentences(t), prose)))

    return let(strip(text), split)


def label_of_item(text: Column) -> Column:
    """struct(label, rest) of an item that opens with a short capitalized label and a colon, or null."""
    t = strip(text)
    label, rest = strip(F.regexp_extract(t, V.LABEL_PATTERN, 1)), strip(F.regexp_extract(t, V.LABEL_PATTERN, 2))
    fits = (label != "") & (rest != "") & (F.length(label) <= V.LABEL_CHARS) & (word_count(label) <= V.LABEL_WORDS)
    return F.when(fits, F.struct(label.alias("label"), rest.alias("rest")))


def trim_colons(name: Column) -> Column:
    """A group name without trailing colons, unless nothing would be left."""
    bare = strip(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), rf"{WS}*:+\z", ""))
    return F.when(bare != "", bare).otherwise(name)


__all__ = ["balanced", "label_of_item", "list_parts", "sentences", "split_cell", "squeeze", "trim_colons"]
