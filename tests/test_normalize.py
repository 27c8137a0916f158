"""Every pass of the normalization on pairs of our own, one document each; expected outcomes are written out."""

import pytest
from model_rows import groups, model, models

from gridloom.functions import vocab as V
from gridloom.operators.items import items
from gridloom.operators.normalize import normalize

PROSE = "All families in the city will have what they need so that children thrive at home, in school and beyond"
RUN_ON = "The staff meet every week to plan. They also write the monthly report together."
ROWS = [
    model("promote", outputs={"General": ["Participation: attendance registers; retention across the term; skills checklists", "Quality: session observations; tutor reflections; an annual external review", "Reach: two partner schools; one community venue; a summer holiday week"]}),
    model("keep general", outputs={"General": ["First plain item", "Aa: one", "Second plain item", "Bb: two", "Cc: three"]}),
    model("grouped already", outputs={"Own name": ["Aa: one", "Bb: two", "Cc: three"]}),
    model("repeated stem", outputs={"General": ["Aa: one", "Aa: two", "Cc: three"]}),
    model("other column", outputs={"General": ["Inputs: one", "Bb: two", "Cc: three"]}),
    model("own column", outputs={"General": ["Outputs: one", "Bb: two", "Cc: three"]}),
    model("two labels", outputs={"General": ["Aa: one", "Bb: two"]}),
    model("few labels", outputs={"General": ["Aa: one", "Bb: two", "Cc: three", "x one", "x two", "x three", "x four"]}),
    model("colons", inputs={"Staff:": ["Trainers"], " : ": ["Rooms"]}),
    model("sentences", activities={"Plan": [{"text": RUN_ON, "fillColor": "red", "sourcePage": 3}]}),
    model("whole cells", activities={"Plan": ["Meetings with Dr. Smith and the dept. Heads of all schools in the whole district", "An opening (bracket that never closes; makes the whole cell; stay as it is here"]}),
    model("mapping", inputs={"Frontline Staff": ["a"], "Resources": ["b"], "Elsewhere": ["c"], "General": ["d"]}, activities={"Outputs": ["e"]}, unmapped={"Notes": ["f"]}),
    model("kept attributes", inputs={"Resources": [{"text": "a", "sourceHeader": "Mine", "mappedBy": "user", "mappingConfidence": "user"}]}),
    model("restated", inputs={"General": ["Trained Staff"]}, unmapped=[("A", ["trained   staff", "other"]), ("B", ["TRAINED STAFF"])]),
    model("harvest", source=f"Intro. Impact Statement: {PROSE}. INPUTS staff", inputs={"General": ["x"]}),
    model("has a statement", source=f"Impact Statement: {PROSE}.", impactStatement="Ours", inputs={"General": ["x"]}),
    model("nothing"),
]


@pytest.fixture(scope="module")
def once(spark):
    return normalize(models(spark, *ROWS)).persist()


@pytest.fixture(scope="module")
def out(once):
    return {r["doc_id"]: r for r in once.collect()}


def test_labelled_lists_become_groups_and_then_parts(out):
    assert groups(out["promote"], "outputs") == {
        "Participation": ["attendance registers", "retention across the term", "skills checklists"],
        "Quality": ["session observations", "tutor reflections", "an annual external review"],
        "Reach": ["two partner schools", "one community venue", "a summer holiday week"],
    }
    assert list(groups(out["keep general"], "outputs").items()) == [("General", ["First plain item", "Second plain item"]), ("Aa", ["one"]), ("Bb", ["two"]), ("Cc", ["three"])]
    assert groups(out["own column"], "outputs") == {"Outputs": ["one"], "Bb": ["two"], "Cc": ["three"]}


@pytest.mark.parametrize("doc", ["grouped already", "repeated stem", "other column", "two labels", "few labels"])
def test_other_columns_keep_their_labels(out, doc):
    before = next(r for r in ROWS if r[0] == doc)
    (name, found), = [(g[0], [i[0] for i in g[1]]) for g in before[1 + 2 + 3 + V.GROUPED.index("outputs")][0]]
    assert groups(out[doc], "outputs") == {name: found}


def test_names_lose_their_colons(out):
    assert list(groups(out["colons"], "inputs").values()) == [["Trainers"], ["Rooms"]] and "Staff" in groups(out["colons"], "inputs")


def test_run_on_cells(out):
    g, = out["sentences"]["activities"]["content"]
    assert [(i["text"], i["fillColor"], i["sourcePage"]) for i in g["items"]] == [("The staff meet every week to plan", "red", 3), ("They also write the monthly report together", "red", 3)]
    assert [len(x) for x in groups(out["whole cells"], "activities").values()] == [2]


def test_mapping(out):
    how = {i["text"]: (i["mappedBy"], i["mappingConfidence"], i["sourceHeader"]) for d in ("inputs", "activities", "unmapped") for g in out["mapping"][d]["content"] for i in g["items"]}
    assert how == {
        "a": ("auto", "subbucket", "Frontline Staff"), "b": ("auto", "synonym", "Resources"), "c": ("auto", "spatial", "Elsewhere"), "d": ("auto", "spatial", None),
        "e": ("auto", "spatial", "Outputs"), "f": (None, "unmapped", "Notes"),
    }
    kept = out["kept attributes"]["inputs"]["content"][0]["items"][0]
    assert (kept["sourceHeader"], kept["mappedBy"], kept["mappingConfidence"]) == ("Mine", "user", "user")


def test_restated_items_go_and_their_groups_with_them(out):
    assert groups(out["restated"], "unmapped") == {"A": ["other"]} and groups(out["restated"], "inputs") == {"General": ["Trained Staff"]}


def test_statements(out):
    assert out["harvest"]["impactStatement"]["content"].rstrip(".") == PROSE and out["has a statement"]["impactStatement"]["content"] == "Ours"


def test_verdicts(out):
    assert out["nothing"]["extractionStatus"] == "abstained" or V.BLOCKERS["noContent"] in out["nothing"]["extractionBlockers"]
    assert any(b.startswith(V.BLOCKERS["groupNamesOtherColumn"]) for b in out["mapping"]["extractionBlockers"])
    assert all(len(r["extractionBlockers"] or ()) <= V.BLOCKERS_MOST for r in out.values())


def test_twice_is_as_once(spark, once):
    leaf = spark.createDataFrame(once.collect(), once.schema)
    assert sorted(map(str, items(normalize(leaf)).collect())) == sorted(map(str, items(leaf).collect()))
