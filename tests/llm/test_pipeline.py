"""The pipeline against plain Python versions of its stages, on a small table."""

import re

import corpus_pipeline as P
from llm import corpus as C
from llm.test_jaccard import brute as components
from llm.test_secretscan import base, entropy

from gridloom.llm import quality


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def cleaned(rows):
    judged = [(r[0], dict(zip(quality.COLUMNS, quality.judge(r[1])))) for r in rows]
    return sorted((d, j["clean_text"]) for d, j in judged if j["kept"])


def test_stages(spark, tmp_path):
    folder = C.write(spark, tmp_path, documents=C.documents(spark, n=80))
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(P.STAGES)
    clean = P.materialize(steps["quality"](spark, docs, folder))
    assert rows_of(clean) == cleaned(C.rows(n=80))
    one = P.materialize(steps["near_duplicates"](spark, clean, folder))
    kept = {d for d, _, c in components(rows_of(clean)) if d == c}
    assert rows_of(one) == sorted({r for r in rows_of(clean) if r[0] in kept})
    safe = P.materialize(steps["secrets"](spark, one, folder))
    for (d, t), (d2, s) in zip(rows_of(one), rows_of(safe)):
        found = [*base(t), *entropy(t)]
        assert d == d2 and (s == t if not found else "[SECRET]" in s)
    mixed = P.materialize(steps["mixing"](spark, safe, folder))
    assert mixed.columns == docs.columns
    words = {d: set(C.WORD.findall(t)) for d, t in rows_of(safe)}
    assert all(set(C.WORD.findall(t)) <= words[d] for d, t in rows_of(mixed))
    total = lambda rows: sum(len(C.WORD.findall(t)) for _, t in rows)
    assert abs(total(rows_of(mixed)) - total(rows_of(safe))) <= 0.05 * total(rows_of(safe)) + 64 * 4
    packed = steps["packing"](spark, mixed, folder).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows_of(mixed)}
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_run(spark, tmp_path):
    folder = C.write(spark, tmp_path, documents=C.documents(spark))
    out = P.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_run_on_nothing(spark, tmp_path):
    assert P.run(spark, C.write(spark, tmp_path, documents=C.empty(spark))).count() == 0


def test_no_import_errors_are_swallowed():
    assert not re.search(r"except\s+ImportError", open(P.__file__).read())


def test_packed_rows_are_whole(spark):
    from gridloom.llm.packing import END_ID
    from gridloom.llm.tokens import encoder

    texts = ["some words of one excerpt", "an excerpt of other words " * 900, "", "some words of one excerpt"]
    out = P.packing(spark, spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string"), "").collect()
    rows = {}
    for r in sorted(out, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        rows.setdefault(r["row"], []).extend(r["ids"])
    enc = encoder(P.vocabulary("word_bpe_49k.json"))
    assert sorted(rows.values()) == sorted([*enc.encode([t])[0].tolist(), END_ID] for t in texts)
