import random

import numpy as np
from llm import corpus as C

from gridloom.llm import langid

SYLLABLES = {"aa": ("ka", "mo", "tu", "ri"), "bb": ("schl", "eng", "ung", "keit"), "cc": ("eau", "ille", "oir", "que")}


def word(draw, lang):
    return "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(2, 4)))


def labelled(seed, n=240):
    draw = random.Random(seed)
    langs = sorted(SYLLABLES)
    return [(i, " ".join(word(draw, langs[i % 3]) for _ in range(draw.randint(8, 60))), langs[i % 3]) for i in range(n)]


def exact_marginals(score, trans, first):
    """Sum over all label paths."""
    n, k = score.shape
    total = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        w = np.exp(first[path[0]] + sum(score[i, c] for i, c in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, c in enumerate(path):
            total[i, c] += w
    return total / total.sum(1, keepdims=True)


def test_forward_backward_equals_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"], None, rng.normal(size=(3, 3)), rng.normal(size=3), {})
    sizes = [1, 5, 2, 6, 1, 4]
    scores = [rng.normal(size=(n, 3)) * 2 for n in sizes]
    starts = np.zeros(sum(sizes), bool)
    starts[np.cumsum([0] + sizes[:-1])] = True
    want = np.concatenate([exact_marginals(s, field.transition, field.first) for s in scores])
    for lanes in (1, 3, 7, 512):
        monkeypatch.setattr(langid, "LANES", lanes)
        assert np.allclose(langid.marginals(np.concatenate(scores), starts, field), want, atol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    score, trans, first = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    gold, live = np.array([[0, 1, 1, 0]]), np.ones((1, 4), bool)

    def likelihood(s, t, f):
        weigh = lambda p: f[p[0]] + sum(s[0, i, c] for i, c in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
        return weigh(gold[0]) - np.log(sum(np.exp(weigh(p)) for p in np.ndindex(2, 2, 2, 2)))

    node, edge, start = langid.gradient(score, trans, first, gold, live)
    for x, g in ((score, node), (trans, edge), (first, start)):
        for at in np.ndindex(*x.shape):
            x[at] += 1e-5
            up = likelihood(score, trans, first)
            x[at] -= 2e-5
            down = likelihood(score, trans, first)
            x[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_held_out_and_code_switched(spark):
    field = langid.fit(spark.createDataFrame(labelled(1), "doc_id long, text string, lang string"))
    fresh = labelled(2, 90)
    out = langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), field).collect()
    assert np.mean([r["lang_pred"] == fresh[r["doc_id"]][2] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    draw = random.Random(5)
    langs = ["aa"] * 12 + ["cc"] * 9 + ["bb"] * 10
    text = " ".join(word(draw, x) for x in langs)
    words = langid.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), field).collect()
    by = {r["doc_id"]: r["words"] for r in words}
    assert np.mean([w["lang"] == x for w, x in zip(by[1], langs)]) > 0.9 and by[2] == []


def test_nothing_to_read(spark):
    field = langid.fit(C.documents(spark))
    out = {r["doc_id"]: r for r in langid.predict(C.documents(spark), field).collect()}
    for r in C.rows():
        if not any(map(str.isalpha, r[1] or "")):
            assert (out[r[0]]["lang_pred"], out[r[0]]["score"]) == ("und", 0.0)
        else:
            assert out[r[0]]["lang_pred"] in ("en", "de", "fr")
    assert langid.fit(C.empty(spark)) is None
    assert langid.predict(C.empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(C.documents(spark), None).collect()} == {"und"}


def test_query_on_the_small_table(spark):
    out = langid.op10_crf_language_id(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in out.collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9


def test_every_character_of_a_long_word_counts():
    word = "k" * 20 + "moturi" * 40 + "z" * 20
    grams = {f"n{word[i : i + 2]}" for i in range(len(word) - 1)} | {f"m{word[i : i + 3]}" for i in range(len(word) - 2)}
    flat, lengths = langid.feature_rows([word, "12", "a"], {})
    assert {langid.zlib.crc32(g.encode()) % langid.FEATURES for g in grams} <= set(flat[: lengths[0]].tolist())
    assert lengths.tolist() == [8 + 2 * len(word) - 3, 0, 8]


def test_long_words_score_as_the_sum_of_their_pieces(monkeypatch):
    weights = np.random.default_rng(3).normal(size=(langid.FEATURES, 3))
    words = ["ab", "x" * 50 + "yz" * 30, "12", "abc" * 100, "é"]
    whole = langid.word_scores(weights, words, {"ab": "a"})
    monkeypatch.setattr(langid, "PIECE", 7)
    monkeypatch.setattr(langid, "GATHER", 30)
    assert np.allclose(langid.word_scores(weights, words, {"ab": "a"}), whole)


def test_sample_is_spread_over_languages_and_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows))
    rows = [(i, "the same words", "aa") for i in range(500)] + [(1000 + i, f"text {i}", "bb") for i in range(300)] + [(2000, "one of its kind", "cc"), (None, "no id", "cc"), (3, None, "aa"), (4, "no lang", None)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limit=60)
    assert sorted({r for r in seen[0] if r[1] != "bb"}) == [("no id", "cc"), ("one of its kind", "cc"), ("the same words", "aa")]
    assert len(seen[0]) == 3 + 20
