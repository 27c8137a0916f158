import random
from collections import Counter

from llm import corpus as C

from gridloom.llm import quality


def brute(text):
    words = C.WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if C.WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_figures(spark):
    rows = C.rows()
    out = quality.clean(C.documents(spark)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda x: (x[0], str(x))
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in out), key=key) == sorted(((r[0], *brute(r[1])) for r in rows), key=key)
    assert all(not r["kept"] for r in out if r["base_failed"])


PHRASES = ("all rights reserved", "privacy policy", "cookie policy", "lorem ipsum", "click here", "read more", "follow us", "back to top")
ENDS = ".!?…:;。！？؟।"


def brute_kept(text):
    """The verdict, rule by rule in plain words, for texts whose boilerplate is among PHRASES."""
    if brute(text)[-1]:
        return False
    before, left, total = set(), 0, 0
    for line in text.split("\n"):
        words = C.WORD.findall(line)
        size = sum(map(len, words))
        total += size
        again = line in before
        before.add(line)
        bars = sum(line.count(c) for c in "|»›•·") + line.count("->") + line.count("::")
        symbols = sum(line.count(c) for c in "#*$%&|<>")
        loud = "!!" in line or len(words) >= 3 and line.upper() == line and line.lower() != line
        stock = any(p in line.lower() for p in PHRASES)
        end = line.strip().rstrip("\"'’”»)]")[-1:]
        if words and not (again or bars > 0.2 * len(words) or symbols > 0.5 * len(words) or loud or stock or end not in ENDS or not end):
            left += size
    return left >= 0.5 * total


def test_verdict_against_brute_force(spark):
    draw = random.Random(8)
    bad = ["Home | About | Jobs | Contact us", "ALL OF THIS IS LOUD.", "no stop here at all and so on", "Read more about all of it.", "$$ %% && ## x.", "what!! a line this is.", "a -> b -> c -> d."]
    rows = []
    for i in range(300):
        lines = C.prose(draw, draw.randint(3, 12)).split("\n")
        lines += [draw.choice(bad) + draw.choice(["", " ", ""]) for _ in range(draw.randint(0, 16))] + [lines[0]] * draw.randint(0, 3) + ["यह एक वाक्य है।", "هل هذا سؤال؟", ""]
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    out = {r["doc_id"]: r["kept"] for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: brute_kept(t) for i, t in rows} and 30 < sum(out.values()) < 270


def test_rules():
    lines = C.prose(random.Random(3), 12).split("\n")
    body = "\n".join(lines)
    bad = ["Home | About | Contact | Jobs", "THIS IS VERY LOUD TEXT.", "All rights reserved by somebody.", "no stop at the end of this", "$$ %% ## ** &&", lines[3]]
    r = dict(zip(quality.COLUMNS, quality.judge(body + "\n" + "\n".join(bad))))
    assert r["kept"] and r["clean_text"] == body
    assert [r[f"lines_{x}"] for x in ("navigation", "shouting", "boilerplate", "punctuation", "symbols", "repeated")] == [1] * 6
    mostly = "\n".join(f"menu entry number {i} of the site map without stop {i}" for i in range(40))
    assert not dict(zip(quality.COLUMNS, quality.judge(mostly)))["kept"]


def test_pipeline_form(spark):
    docs = C.documents(spark)
    kept = quality.keep_clean(docs)
    verdict = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert kept.columns == docs.columns
    found = kept.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in C.rows() if verdict[r[0]]["kept"])
    assert all(r["text"] == verdict[r["doc_id"]]["clean_text"] and r["n_chars"] == len(r["text"]) for r in found)
    assert quality.keep_clean(C.empty(spark)).count() == 0 and quality.clean(C.empty(spark)).count() == 0
