"""The statement under its heading: cases, a plain loop over random texts, and a megabyte in time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridloom.functions import vocab as V
from gridloom.operators.harvest import labelled_statement

PROSE = "Through steady practice, students of our studio will find a place for their own work that builds skill, patience and self-worth, and long-term careers in the arts."


# A plain loop over matches, one text at a time.
HEADING = re.compile(V.STATEMENT_HEADING, re.I | re.A)
STOPS = re.compile(V.STATEMENT_STOPS, re.I | re.A)
PEOPLE, CHANGE = re.compile(V.POPULATION, re.I | re.A), re.compile(V.CHANGE, re.I | re.A)
SENTENCE_END = re.compile(r"[.!?][\"'“”)\]*_~`]*\s+")


def reads_as_list(s: str) -> bool:
    """Two list markers or two bold spans."""
    return len(re.findall(r"(?:^|\s)(?:[-•*]\s+|\d+[.)]\s+)", s)) >= 2 or len(re.findall(r"\*\*[^*]+\*\*", s)) >= 2


def is_statement(s: str) -> bool:
    """80 to 600 characters of prose about people and a change."""
    t = " ".join(s.split())
    listed = re.match(r"[-•*]|\d+[.)]", t) or reads_as_list(t)
    return V.STATEMENT_LEAST <= len(t) <= V.STATEMENT_MOST and not listed and bool(PEOPLE.search(t) and CHANGE.search(t))


def without_markup(s: str) -> str:
    return " ".join(re.sub(r"[*_`~]", "", re.sub(r"\\([\\`*_{}\[\]()#+\-.!])", r"\1", s)).split())


def statement_after(flat: str) -> str:
    """The text up to the next heading: a stop word that only capitals lead up to since a sentence end."""
    body = re.sub(r"^[:\-–—\s]+", "", flat)
    for stop in STOPS.finditer(body):
        ends = [m.end() for m in SENTENCE_END.finditer(body, 0, stop.start())]
        if not re.search("[a-z]", body[ends[-1] if ends else 0 : stop.start()]):
            # A longer heading leaves its first word behind the last sentence.
            body = re.sub(r"([.!?][\"'“”)]*)\s+\S+\s*$", r"\1", body[: stop.start()])
            break
    return re.sub("^[\"'“”]+|[\"'“”]+$", "", " ".join(body.split())).strip()


def by_hand(text: str | None) -> str | None:
    """The impact statement under its heading in a text: the slice itself, or the first sentence after
    the heading that reads as one. Without a heading there is none."""
    flat = " ".join((text or "").split())
    heading = HEADING.search(flat)
    if not heading:
        return None
    body = statement_after(flat[heading.end() :])
    if V.STATEMENT_LEAST <= len(body) <= V.STATEMENT_MOST and not reads_as_list(body):
        return without_markup(body)
    rest = flat[heading.end() :]
    for sentence in re.findall(r"[^.!?]+[.!?]+", rest) or [rest]:
        if is_statement(sentence):
            return without_markup(sentence)
    return None


def harvested(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["s"] for r in df.select("i", labelled_statement(F.col("text")).alias("s")).orderBy("i").collect()]


CASES = [
    (f"## Page 1\nA Model\nIMPACT STATEMENT\n\n\n{PROSE}\n## Page 2\nResources Activities", f"{PROSE} ## Page 2 Resources Activities"),
    (f"Intended Impact {PROSE} Resources", PROSE),
    (f"Long-Term Impact: {PROSE} RESOURCES Staff", PROSE),
    (f"IMPACT STATEMENT **{PROSE}** Resources and more", PROSE),
    (f"IMPACT STATEMENT {PROSE} BRIEF PROGRAM OVERVIEW/MISSION whom we serve", PROSE),
    (f"Page 1. {PROSE}", None),
    ("Resources Activities Outputs", None),
    ("6. LONG-TERM IMPACT (3-5 years)** **For Students** - Increased graduation rates of all kinds - Careers in many fields - Stronger bonds - Long-term change for families", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_cases_by_hand(at):
    assert by_hand(CASES[at][0]) == CASES[at][1]


def test_cases(spark):
    assert harvested(spark, [c for c, _ in CASES]) == [want for _, want in CASES]


def test_random_texts(spark):
    draw = random.Random(12)
    parts = ["Impact Statement", "long-term impact", "INPUTS", "Outputs", "who we serve", "mission/", "MISSION STATEMENT", "short-term", "students", "will", "improve", "BRIEF", "the work of many hands", "- ", "1. ", "**bold**", ".", "!", ". ", ".) ", "? “", ":", "—", "  ", "\n", "## Page 2", "É", "children", "support", PROSE, PROSE[:90]]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", " ", ""]) for _ in range(draw.randint(3, 40))) for _ in range(1500)]
    texts += [f"Impact Statement {t}" for t in texts[:500]]
    want = [by_hand(t) for t in texts]
    assert harvested(spark, texts) == want and sum(w is not None for w in want) > 200


def test_a_megabyte(spark):
    text = "IMPACT STATEMENT " + "the outputs and resources of long-term work in our purpose. " * 17_500
    df = spark.createDataFrame([(text,)], "text string").select(F.length(labelled_statement(F.col("text"))).alias("n"))
    df.collect()
    began = time.time()
    assert df.first()["n"] is None
    assert time.time() - began < 10  # about a second where nothing else runs
