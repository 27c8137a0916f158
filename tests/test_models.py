"""Exports, rules, slices, sheets, edits, sessions and streams on small inputs, outcomes written out."""

import zipfile
import random
from datetime import datetime

import pytest
from model_rows import model, models
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import vocab as V
from gridloom.operators import edits, exports, rules, sessions, slicing
from gridloom.operators.items import items
from gridloom.sources import sheets
from gridloom.streaming import corrections

FILES = "doc_id string, file_name string, status string, split_part_label string, document_hash string, error string, warnings array<string>, pages_processed int"


@pytest.fixture(scope="module")
def two(spark):
    return models(
        spark,
        model("a", organization='Say "hi"', program="P", mission=" Our mission ", inputs={"Staff": ["x, y", " ", {"text": "z", "verbatim": False, "sourcePage": 2}]}, impact={None: ["end"]}, extractionBlockers=["one", "", "two"]),
        model("b", shortTermOutcomes={"": [{"text": "o", "fillColor": " Red ", "borderColor": "blue"}]}, unmapped={"N": ["u"]}),
    ).drop("sourceText", "lowLegibility", "textOnlyFallback")


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", "a.pdf", "completed", None, "h", None, ["w1", "w2"], 3), ("b", "b.pptx", "editing", "Part 1 of 2", None, None, None, 0), ("c", "c.docx", "error", None, None, "bad", None, None), ("d", "d.pdf", "extracting", None, None, None, None, None)]
    return spark.createDataFrame(rows, FILES)


def test_full_rows(two, files):
    found = exports.full_rows(two, files)
    assert exports.unaccounted(found) == [] and exports.unaccounted(found.withColumn("new", F.lit(1))) == ["new"]
    rows = {r["row_id"]: r for r in found.collect()}
    assert set(rows) == {"a-mission", "a-inputs-0-0", "a-inputs-0-2", "a-impact-0-0", "b-shortTermOutcomes-0-0", "b-unmapped-0-0"}
    assert rows["a-mission"]["content"] == " Our mission " and rows["a-inputs-0-2"]["needs_review"] == "Yes" and rows["a-inputs-0-2"]["source_page"] == "2"
    assert rows["a-impact-0-0"]["extraction_blockers"] == "one | two" and rows["b-unmapped-0-0"]["source_filename"] == "b.pptx — Part 1 of 2"
    assert all(v is not None for r in rows.values() for k, v in r.asDict().items() if k not in ("doc_id", "domain_ord", "group_ord", "item_ord"))


def test_coding_and_log(two, files):
    r, = exports.coding_rows(two, files).collect()
    assert (r["group"], r["domain"], r["color_coding"], r["source_type"]) == ("General", "Short-Term Outcomes", "Red border:blue", "logic_model")
    log = {r["doc_id"]: r for r in exports.log_rows(two, files).collect()}
    assert set(log) == {"a", "b", "c"} and (log["c"]["qa_status"], log["c"]["error_message"], log["c"]["total_items"], log["c"]["source_format"]) == ("Error", "bad", "0", "docx")
    assert (log["a"]["warnings"], log["a"]["pages_processed"], log["b"]["pages_processed"], log["b"]["unmapped_items"]) == ("w1 | w2", "3", "", "1")


def test_csv(spark, two, files, tmp_path):
    exports.write_csv(exports.full_rows(two, files), V.FULL_COLUMNS, f"{tmp_path}/out", ("doc_id", "domain_ord", "group_ord", "item_ord"))
    texts = [p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size]
    assert all(t.startswith(V.BOM + '"Row ID","Organization"') for t in texts) and sum(t.count("\n") - 1 for t in texts) == 6
    assert any('"a-inputs-0-0","Say ""hi""","P","Inputs","Staff","x, y"' in t for t in texts)
    assert exports.csv_lines(exports.coding_rows(two, files.where("doc_id = 'd'")), V.CODING_COLUMNS).count() == 0


def test_roundtrip(monkeypatch, two, files):
    assert exports.roundtrip(two, files).count() == 0
    whole = exports.full_rows
    tampered = lambda m, f: whole(m, f).where("row_id <> 'a-inputs-0-0'").withColumn("domain_label", F.when(F.col("row_id") == "b-unmapped-0-0", "Impact").otherwise(F.col("domain_label")))
    monkeypatch.setattr(exports, "full_rows", tampered)
    found = sorted((r["key"], r["domain"], r["text"], r["n_model"], r["n_export"]) for r in exports.roundtrip(two, files).collect())
    assert found == [("a.pdf", "inputs", "x, y", 1, 0), ("b.pptx — Part 1 of 2", "impact", "u", 0, 1), ("b.pptx — Part 1 of 2", "unmapped", "u", 1, 0)]


def test_printed_columns(spark):
    df = models(spark, model("a", generalOutcomes={"g": ["x"]}), model("b", generalOutcomes={"g": ["x"]}, longTermOutcomes={"g": ["y"]}))
    found = {}
    for r in exports.printed_columns(df).orderBy("doc_id", "ord").collect():
        found.setdefault(r["doc_id"], []).append(r["domain"])
    assert found == {"a": ["inputs", "activities", "outputs", "generalOutcomes"], "b": ["inputs", "activities", "outputs", "shortTermOutcomes", "mediumTermOutcomes", "longTermOutcomes"]}


def test_rules(spark):
    df = models(spark, model("a", impactStatement="Thriving children", mission="thriving  CHILDREN", inputs={"Lead Staff": ["Two trainers", "money"], "General": ["x"]}, activities={"General": ["two TRAINERS again"]}))
    want = spark.createDataFrame([("a", "inputs", "staff", "two  trainers", ["activities", "outputs"]), ("a", "inputs", "rooms", "money", None), ("a", "outputs", None, "gone", None)], "doc_id string, domain string, group_name string, needle string, forbidden array<string>")
    groups = spark.createDataFrame([("a", "inputs", "Staff"), ("a", "impact", "Any")], "doc_id string, domain string, group_name string")
    nowhere = spark.createDataFrame([("a", "MONEY"), ("a", "absent")], "doc_id string, needle string")
    general = spark.createDataFrame([("a", "inputs"), ("a", "activities")], "doc_id string, domain string")
    statement = spark.createDataFrame([("a", True, ["children", "adults"], ["mission", "inputs"], "mission")], "doc_id string, required boolean, contains array<string>, must_not_be_in array<string>, not_duplicate string")
    found = sorted((r["rule"], r["domain"], r["detail"]) for r in rules.fixture_breaches(df, want, groups, nowhere, general, statement, spark.createDataFrame([("a", "inputs"), ("a", "unmapped")], "doc_id string, domain string")).collect())
    assert found == [
        ("empty", "unmapped", ""), ("fabricated", "inputs", "MONEY"), ("forbidden", "activities", "two  trainers"), ("general_only", "inputs", "Lead Staff"), ("group", "impact", "Any"),
        ("missing", "inputs", "money"), ("missing", "outputs", "gone"), ("statement_in_mission", "impactStatement", ""), ("statement_is_mission", "impactStatement", ""), ("statement_lacks", "impactStatement", "adults"),
    ]
    assert rules.fixture_breaches(df).count() == 0


def test_nesting(spark):
    df = models(spark, model("a", outputs={"Reach": ["Reach: two schools", "Schools", "schools — north", "schools : south", "Schools-West", "well-known", "well"], "General": ["General: fine"]}))
    found = sorted((r["kind"], r["text"], r["example"] or "") for r in rules.nesting_breaches(df).collect())
    assert found == [("group_name_repeated_in_item", "Reach: two schools", ""), ("parent_label_as_item", "Schools", "schools — north"), ("parent_label_as_item", "well", "well-known")]
    assert 'Outputs/Reach: item repeats its own group name — "Reach: two schools"' in [r["line"] for r in rules.nesting_lines(rules.nesting_breaches(df)).collect()]


def test_slices(spark):
    text = "front\n## Page 1\none\n\n ## slide 2 \ntwo\n## Page 3\nthree"
    schema = "doc_id string, images array<string>, imageRefs array<struct<page:int,column:int>>, previewImages array<string>, textTrack string, warnings array<string>, sourceFormat string, lowLegibility boolean"
    rows = [
        ("a", ["i1", "i2a", "i2b", "i3"], [(1, None), (2, 1), (2, 2), (3, None)], ["p1", "p2", "p3"], text, ["Page 1 of this is blurred", "Page 3 of this is blurred", "all"], "pdf", True),
        ("b", ["i"], None, [], "no markers", ["low resolution"], "pdf", True), ("c", [], None, None, "", [], "xlsx", False),
    ]
    whole = slicing.assembled(spark.createDataFrame(rows, schema))
    by = {r["doc_id"]: r for r in whole.collect()}
    assert by["a"]["warnings"][-1] == V.LOW_LEGIBILITY and by["b"]["warnings"] == ["low resolution"] and by["c"]["imageRefs"] is None and by["c"]["previewImages"] is None
    assert by["b"]["previewImages"] == ["i"] and [tuple(r) for r in by["b"]["imageRefs"]] == [(1, None)]
    ranges = spark.createDataFrame([("a", 2, 3), ("a", 1, 1), ("b", 2, 2)], "doc_id string, start int, end_ int")
    cut = {(r["doc_id"], r["start"]): r for r in slicing.sliced(whole, ranges).collect()}
    assert cut["a", 2]["textTrack"] == "## slide 1\ntwo\n## Page 2\nthree" and cut["a", 1]["textTrack"] == "## Page 1\none" and cut["b", 2]["textTrack"] == "no markers"
    assert cut["a", 2]["images"] == ["i2a", "i2b", "i3"] and [tuple(r) for r in cut["a", 2]["imageRefs"]] == [(1, 1), (1, 2), (2, None)] and cut["a", 2]["previewImages"] == ["p2", "p3"]
    assert cut["a", 2]["warnings"] == ["Page 2 of this is blurred", "all", V.LOW_LEGIBILITY]
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y")], "doc_id string, page int, image string")
    assert sorted(map(tuple, slicing.pages_in_range(pages, ranges).select("start", "page", "image").collect())) == [(1, 1, "x"), (2, 2, "y")]


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


def test_office_files(spark, tmp_path):
    sheet = '<row r="1"/><row><c r="B2" t="s"><v>0</v></c><c><v>1.5</v></c><c r="AA2" t="b"><v>1</v></c></row><row><c r="A3" t="s"><v>9</v></c></row><row><c r="C4" t="inlineStr"><is><t>a&amp;lt;|b\n c</t></is></c></row>'
    office(tmp_path / "w.xlsx", {"xl/workbook.xml": '<sheet name="One"/><sheet name=""/>', "xl/sharedStrings.xml": "<si><r><t>He</t></r><r><t>ad</t></r></si>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet10.xml": "<row><c><v>last</v></c></row>", "xl/worksheets/sheet2.xml": "<row><c><v>7</v></c></row>", "docProps/x.xml": ""})
    office(tmp_path / "d.pptx", {"ppt/slides/slide10.xml": "<a:t>ten</a:t>", "ppt/slides/slide2.xml": '<a:t>two &amp;</a:t><a:p/><a:t lang="en"> more\n text</a:t>', "ppt/slides/slide3.xml": "<p/>"})
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    parts = sheets.office_parts(spark, str(tmp_path))
    assert parts.where("part is null").first()["doc_id"] == "broken.xlsx"
    w = sheets.workbook_text(parts).first()
    wide = lambda *cells: "| " + " | ".join([*cells, *[""] * (27 - len(cells))]) + " |"
    head = "| " + " | ".join(["", "Head", "1.5", *[""] * 23, "TRUE"]) + " |"
    assert w["textTrack"] == f"## Sheet: One\n\n{head}\n{'| ' + ' | '.join(['---'] * 27) + ' |'}\n{wide('', '', 'a&lt;\\|b — c')}\n\n## Sheet: Sheet 2\n\n| 7 |\n| --- |\n\n## Sheet: Sheet 3\n\n| last |\n| --- |"
    assert w["n_sheets"] == 3 and w["warnings"][0].startswith("This spreadsheet has 3 sheets")
    assert sheets.deck_text(parts).first()["textTrack"] == "## Slide 2\n\ntwo & more text\n\n## Slide 10\n\nten"
    assert {r["doc_id"]: r["sourceFormat"] for r in sheets.office_text(spark, str(tmp_path)).collect()} == {"w.xlsx": "xlsx", "d.pptx": "pptx"}


def test_grids(spark):
    row = spark.createDataFrame([([["", " "], ["", "a"], ["b"], [""]],)], "g array<array<string>>").select(sheets.trimmed(F.col("g")).alias("t"), sheets.markdown(sheets.trimmed(F.col("g"))).alias("m")).first()
    assert row["t"] == [["", " "], ["", "a"], ["b", ""]] and row["m"] == "|  | a |\n| --- | --- |\n| b |  |"
    refs = spark.createDataFrame([("A1",), ("Z9",), ("AA1",), ("bc12",), ("7",)], "r string").select(sheets.column_index(F.col("r"))).collect()
    assert [r[0] for r in refs] == [0, 25, 26, 54, -1]


def test_moves(spark):
    df = models(spark, model("a", inputs={"Staff": ["one", "two"], "General": ["three"]}, impact={"General": [" ONE "]}, unmapped={"Notes": ["n"]})).drop("sourceText", "lowLegibility", "textOnlyFallback")
    rows = [("a", "inputs", 0, 0, "impact", None, "1"), ("a", "inputs", 0, 0, "unmapped", " why ", "2"), ("a", "unmapped", 0, 0, "impact", None, "3"), ("a", "impact", 0, 1, "outputs", None, "4"), ("a", "inputs", 9, 9, "impact", None, "5")]
    families = spark.createDataFrame([("a", "diagram")], "doc_id string, layoutFamily string")
    after, events = edits.moved(items(df), spark.createDataFrame(rows, "doc_id string, domain string, group_ord int, item_ord int, to_domain string, note string, at string"), families)
    assert sorted((r["domain"], r["group_name"], r["text"], r["mappedBy"]) for r in after.collect()) == [("impact", "General", " ONE ", None), ("inputs", "General", "three", None), ("outputs", "General", "n", "user"), ("unmapped", "Staff", "two", "user")]
    assert [(r["itemText"], r["action"], r["fromDomain"], r["toDomain"], r["itemKey"], r["note"], r["layoutFamily"], r["fileId"]) for r in events.orderBy("at").collect()] == [
        ("one", "remap_domain", "inputs", "impact", "Staff|one|0", None, "diagram", ""), ("two", "return_unmapped", "inputs", None, "Staff|two|0", "why", "diagram", ""),
        ("n", "assign_domain", None, "impact", "Notes|n|0", None, "diagram", ""), ("n", "remap_domain", "impact", "outputs", "Notes|n|1", None, "diagram", ""),
    ]
    made = {r["text"]: (r["group_ord"], r["item_ord"], r["sourceHeader"]) for r in after.collect()}
    assert made["n"] == (0, 0, "Notes") and made["two"] == (0, 0, "Staff")


def moved_by_hand(model, log):
    """A plain loop over one nested document: {domain: [[name, [item]]]}, moves (domain, group, item, to, note)."""
    events = []
    for domain, g, i, to, note in log:
        try:
            name, found = model[domain][g]
            item = dict(found[i])
        except IndexError:
            continue
        if not item["header"] and name not in ("", "General"):
            item["header"] = name
        found.pop(i)
        model[domain] = [x for x in model[domain] if x[1]]
        wanted = "General" if to != "unmapped" else item["header"] or name or "Unmapped"
        for x in model[to]:
            if x[0] == wanted:
                break
        else:
            x = [wanted, []]
            model[to].append(x)
        if item["text"].strip().lower() not in [y["text"].strip().lower() for y in x[1]]:
            x[1].append(item)
        events.append((domain if domain != "unmapped" else None, to if to != "unmapped" else None, f"{item['header'] or ''}|{item['text'].strip()}|{i}", note.strip() or None))
    return model, events


def test_random_logs_of_moves(spark):
    draw = random.Random(6)
    documents, log, expected = [], [], {}
    for d in map(str, range(12)):
        grid = {f: [[n, [{"text": draw.choice("abcdef") + draw.choice(["", " "]) + "x" * draw.randint(0, 2), "header": draw.choice([None, "H"])} for _ in range(draw.randint(1, 4))]] for n in draw.sample(["General", "Staff", "Work", ""], draw.randint(0, 3))] for f in ("inputs", "outputs", "unmapped")}
        documents.append(model(d, **{f: [(n, [{"text": i["text"], "sourceHeader": i["header"]} for i in found]) for n, found in gs] for f, gs in grid.items()}))
        moves = [(draw.choice(list(grid)), draw.randint(0, 2), draw.randint(0, 3), draw.choice(list(grid)), draw.choice(["", " n "])) for _ in range(draw.randint(0, 30))]
        log += [(d, f, g, i, to, note, "t", k) for k, (f, g, i, to, note) in enumerate(moves)]
        expected[d] = moved_by_hand(grid, moves)
    df = models(spark, *documents).drop("sourceText", "lowLegibility", "textOnlyFallback")
    after, events = edits.moved(items(df, blank=True), spark.createDataFrame(log, "doc_id string, domain string, group_ord int, item_ord int, to_domain string, note string, at string, seq int"))
    places = sorted((r["doc_id"], r["domain"], r["group_ord"], r["group_name"], r["item_ord"], r["text"], r["sourceHeader"]) for r in after.collect())
    assert places == sorted((d, f, g, n, i, x["text"], x["header"]) for d, (grid, _) in expected.items() for f, gs in grid.items() for g, (n, found) in enumerate(gs) for i, x in enumerate(found))
    got = sorted(str((r["doc_id"], r["fromDomain"], r["toDomain"], r["itemKey"], r["note"])) for r in events.collect())
    assert got == sorted(str((d, *e)) for d, (_, es) in expected.items() for e in es)


def test_edits(spark):
    df = models(spark, model("a", inputs={"Staff": [{"text": "one", "verbatim": False}, "two", "three"]}))
    changes = [("a", "inputs", 0, 0, "1", "new", None, None), ("a", "inputs", 0, 0, "2", None, True, "seen"), ("a", "inputs", 0, 1, "1", " ", None, None)]
    out = edits.edited(items(df), spark.createDataFrame(changes, "doc_id string, domain string, group_ord int, item_ord int, at string, text string, reviewed boolean, note string"))
    assert sorted((r["text"], r["verbatim"], r["sourceNote"]) for r in out.collect()) == [("new", True, "seen"), ("three", None, None)]


def test_sessions(spark, two, files):
    flags = {r["doc_id"]: r for r in sessions.flagged(files.withColumn("blockers", F.expr("cast(null as array<string>)")), two).collect()}
    assert {d: r["bucket"] for d, r in flags.items()} == {"a": "ready", "b": "ready", "c": "flagged", "d": "busy"} and flags["c"]["reason"] == "bad" and flags["a"]["summary"] == "3 items"
    kept = {r["doc_id"]: r for r in sessions.checkpoints(files.select("doc_id", "status", "error")).collect()}
    assert kept["d"]["status"] == "pending" and len({r["record_key"] for r in kept.values()}) == 4
    records = spark.createDataFrame([("1", "s", None), ("2", "s", None), ("3", None, "own"), ("4", "lost", None)], "doc_id string, source_document_id string, content string")
    blobs = spark.createDataFrame([("s", "shared")], "id string, content string")
    assert {r["doc_id"]: r["content"] for r in sessions.restored(records, blobs).collect()} == {"1": "shared", "2": "shared", "3": "own"}
    one = records.where("doc_id = '1'")
    left, still = sessions.deleted(records, blobs, one)
    assert left.count() == 3 and still.count() == 1 and sessions.deleted(records, blobs, records.where("source_document_id = 's'"))[1].count() == 0
    assert sessions.saved(records, one.withColumn("content", F.lit("new"))).where("content = 'new'").count() == 1
    bundles = spark.createDataFrame([("a", "text", ["i", ""])], "doc_id string, textTrack string, images array<string>")
    seed = bundles.select(sessions.seed(F.lit("text\0i"))).first()[0]
    assert sessions.replays(bundles, spark.createDataFrame([(seed, "x"), (1, "y")], "seed int, answer string")).first()["answer"] == "x"
    keys = spark.createDataFrame([("b",), ("a",), ("a",)], "capture_key string")
    assert [r[0] for r in sessions.complete_captures(keys, keys.where("capture_key = 'a'")).collect()] == ["a"]
    done = spark.createDataFrame([(i, f"f{i}", "empty" if i < 6 else "drawn") for i in range(8)] + [(9, "g", "failed")], "ord int, name string, outcome string")
    assert sessions.batch_outcome(done).first()[0] == "Downloaded 2 of 9 PDFs. 6 files had nothing to put in a PDF: f0, f1, f2, f3, f4 and 1 more. 1 file couldn't be drawn: g."
    assert sessions.batch_outcome(done.where("outcome = 'drawn'")).first()[0] is None


def test_labels(spark):
    row = spark.createDataFrame([("a\n  b" + "x" * 300, '{"modelVersion": " m "}', '{"modelVersion": 3}', "aGk=", "??")], "reason string, ok string, no string, good string, bad string")
    r = row.select(L.fallback_warning("reason").alias("w"), L.served_model("ok").alias("m"), L.served_model("no").alias("n"), L.payload("good").alias("g"), L.status_label(F.lit("editing")).alias("s"), L.prompt_variant(F.lit(True), F.lit(False), F.lit(True)).alias("v"), L.colour_notes(F.lit("cross_cutting"), F.lit(False), F.array(F.lit("inputs"))).alias("c"), L.has_colour(F.lit(" RED"), F.lit("red")).alias("h"), L.friendly_error(F.lit("HTTP 429")).alias("e"), L.friendly_error(F.lit(None).cast("string")).alias("z")).first()
    assert r["w"].startswith(V.TEXT_ONLY + " Reason: a bxxx") and r["w"].endswith("…") and (r["m"], r["n"], bytes(r["g"]), r["s"], r["v"], r["h"]) == ("m", None, b"hi", "Ready to edit", "vision-only+lowleg", True)
    assert r["c"] == [V.COLOUR_NO_KEY, f"Inputs is {V.COLOUR_STAMPED}"] and r["e"] == "The model's service is rate-limiting requests. Wait a moment, then try again." and r["z"] == "Something went wrong"


def test_errors_that_surface(spark):
    rows = [("vision is down, 401", "VisionUnavailableError"), ("vision is down, 401", "Error"), ("vision is down", None), (None, "VisionConversionFailedError")]
    df = spark.createDataFrame(rows, "message string, kind string")
    told = [r[0] for r in df.select(L.friendly_error("message", "kind", "Model", "KEY")).collect()]
    assert told == ["vision is down, 401", "Couldn't reach Model — check that KEY is set.", V.ERRORS[4][1], ""]
    assert [r[0] for r in df.select(L.surfaces("kind")).collect()] == [True, False, False, True]
    deck = spark.createDataFrame([(" a\n b ", True), ("x" * 300, False), (None, False)], "cause string, retried boolean").select(L.deck_failure("cause", "retried")).collect()
    assert deck[0][0] == "Couldn't convert this deck to pages (a b)." + V.DECK_RETRIED and "…)." in deck[1][0] and deck[2][0] == "Couldn't convert this deck to pages." + V.DECK_REFUSED


def test_streams(spark, tmp_path):
    log = [("k1", datetime(2024, 1, 1), 1, "inputs"), ("k2", datetime(2024, 1, 1), 2, "impact"), ("k1", datetime(2024, 1, 2), 3, "outputs")]
    for i, row in enumerate(log):
        spark.createDataFrame([row], corrections.CORRECTION).write.parquet(f"{tmp_path}/log/{i}")
    stream = corrections.correction_log(spark, f"{tmp_path}/log/*", 1)
    corrections.keep_current(corrections.current_corrections(stream), f"{tmp_path}/now", f"{tmp_path}/check").awaitTermination(120)
    found = {r["item_key"]: (r["to_domain"], r["n"]) for r in corrections.current_rows(spark, f"{tmp_path}/now", "item_key").collect()}
    assert found == {"k1": ("outputs", 2), "k2": ("impact", 1)}
    states = spark.createDataFrame([("d", datetime(2024, 1, 1), 1, "pending"), ("d", datetime(2024, 1, 1), 2, "extracting")], corrections.STATE)
    assert tuple(corrections.current_states(states).select("status", "resumed").first()) == ("extracting", "pending")
