import random
import re

from gridloom.operators.layout import page_texts

SCHEMA = "doc_id long, page int, run_no int, str string, height double, eol boolean"


def plain(runs):
    """The same, run by run."""
    out = {}
    for doc, page in sorted({(r[0], r[1]) for r in runs}):
        lines, words, high = [], [], 0.0
        for _, _, _, text, height, eol in [*sorted((r for r in runs if r[:2] == (doc, page)), key=lambda r: r[2]), (0, 0, 0, None, None, True)]:
            if text:
                words.append(text)
                high = max(high, abs(height or 0.0))
            if eol:
                line = re.sub(r"\s+", " ", " ".join(words)).strip()
                lines += [(line, high)] if line else []
                words, high = [], 0.0
        heights = sorted(h for _, h in lines if h > 0)
        mid = heights[len(heights) // 2] if heights else 0
        body = "\n".join("### " + t if mid > 0 and h >= 1.35 * mid and len(t) <= 120 else t for t, h in lines)
        out[doc] = out.get(doc, "") + f"\n\n## Page {page}\n\n{body}"
    return {d: t.strip() for d, t in out.items()}


def test_pages_from_runs(spark):
    draw = random.Random(3)
    strings = ["Inputs", "two words", " \t", "", None, "x" * 130, "end ", "\u00e9t\u00e9"]
    runs = [
        (doc, page, n, draw.choice(strings), draw.choice([None, 0.0, -9.0, 10.0, 10.0, 13.5, 14.0, 20.0]), draw.choice([True, False, False, None]))
        for doc in range(12) for page in range(1, draw.randint(2, 13)) for n in range(draw.randint(1, 25))
    ]
    runs += [(99, 1, 0, None, None, True)]
    rows = page_texts(spark.createDataFrame(draw.sample(runs, len(runs)), SCHEMA)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == plain(runs)
    assert page_texts(spark.createDataFrame([], SCHEMA)).count() == 0
