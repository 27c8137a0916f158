from collections import Counter

from llm import corpus as C
from public_tokenizers import path
from tokenizers import Tokenizer

from gridloom.llm import tokencount


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "STEP", 64)
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    lengths = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in C.rows()]
    hist = tokencount.histogram(tokencount.encoded_lengths(C.documents(spark), path("word_bpe_49k.json"), 1))
    rows = {r["n_tokens"]: r for r in hist.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r["docs_longer"] == sum(n > k for n in lengths)
        assert r["docs_up_to"] == sum(n <= k for n in lengths)
        assert r["tokens_up_to"] == sum(n for n in lengths if n <= k)
        assert r["tokens_longer"] == sum(n for n in lengths if n > k)
        assert r["truncated_total"] == sum(min(n, k) for n in lengths)
        assert abs(r["quantile"] - sum(n <= k for n in lengths) / len(lengths)) < 1e-12
    for limit in (1, 50, 333, 10**6):
        assert tokencount.truncated_total(hist, limit).first()[0] == sum(min(n, limit) for n in lengths)
    assert tokencount.quantile(hist, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_empty(spark):
    assert tokencount.histogram(tokencount.encoded_lengths(C.empty(spark), path("word_bpe_49k.json"))).count() == 0
