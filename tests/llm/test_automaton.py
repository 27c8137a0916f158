"""The automaton against the tokenizers library."""

import hashlib
import json
import random
import unicodedata

import pytest
from llm import corpus as C
from public_tokenizers import path
from tokenizers import Tokenizer

from gridloom.llm import automaton as A

FILE = path("byte_bpe_50k.json")
ODD = list(" \n\t\x0b\x1c\x85\xa0 　'saAtre1234!?-_.éßñ×") + ["<|endoftext|>", "'s", "'ll", "  ", " the", "tion", "\x00"]
SCRIPTS = [chr(c) for c in range(1, 0x30000, 31) if unicodedata.category(chr(c)) != "Cs"]


@pytest.fixture(scope="module")
def pair():
    return A.Automaton(FILE), Tokenizer.from_file(FILE)


def check(pair, text):
    own, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, repr(text)
    assert A.spell(own.labels, ids) == library.decode(ids, skip_special_tokens=False)


def test_fuzz(pair):
    draw = random.Random(3)
    for _ in range(12_000):
        check(pair, "".join(draw.choice(ODD if draw.random() < 0.7 else SCRIPTS) for _ in range(draw.randint(0, 20))))
    for _ in range(4_000):
        check(pair, "".join(draw.choice("abehinostr") for _ in range(draw.randint(1, 60))))


def test_long_words(pair):
    for text in ("a" * 5000, "ab" * 3000 + "aab" * 999, "0123456789" * 500, "é" * 2001, "-" * 777, "\n" * 50 + "x"):
        check(pair, text)


def test_decoding_of_any_ids(pair):
    draw = random.Random(4)
    for _ in range(500):
        ids = [draw.randrange(50257) for _ in range(8)]
        assert A.spell(pair[0].labels, ids) == pair[1].decode(ids, skip_special_tokens=False)
    assert A.spell(pair[0].labels, [-1, 10**6]) == ""


def test_forgetting(monkeypatch):
    monkeypatch.setattr(A, "CACHE_PIECES", 50)
    monkeypatch.setattr(A, "CACHE_ARCS", 40)
    pair = A.Automaton(FILE), Tokenizer.from_file(FILE)
    for text in C.texts():
        check(pair, text)
    assert len(pair[0].known) <= 50


def small_file(folder, merges):
    """A byte-level vocabulary with merges of our own, among them one that no text reaches."""
    spec = json.loads(open(FILE, encoding="utf-8").read())
    tokens = sorted(A.byte_letters()) + [a + b for a, b in merges]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    spec["added_tokens"] = []
    (folder / "small.json").write_text(json.dumps(spec), encoding="utf-8")
    return str(folder / "small.json")


def test_every_order_of_merges(tmp_path):
    """Random merge lists, dead merges and repeated letters included: all strings of up to 7 letters."""
    draw = random.Random(8)
    for _ in range(25):
        tokens, merges = ["a", "b"], []
        for _ in range(9):
            a, b = draw.choice(tokens), draw.choice(tokens)
            if a + b not in tokens and len(a + b) < 7:
                tokens.append(a + b)
                merges.append([a, b])
        file = small_file(tmp_path, merges)
        pair = A.Automaton(file), Tokenizer.from_file(file)
        for n in range(1, 8):
            for k in range(2**n):
                check(pair, format(k, f"0{n}b").translate({48: "a", 49: "b"}))


def test_query(spark, tmp_path, pair):
    folder = C.write(spark, tmp_path, documents=C.documents(spark))
    out = sorted(tuple(r) for r in A.op12_tokenization_automaton(spark, folder).collect())
    expected = []
    for doc_id, text, *_ in C.rows():
        ids = pair[1].encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), pair[1].decode(ids, skip_special_tokens=False))]
        expected.append((doc_id, len(ids), *digests))
    assert out == sorted(expected)
    assert A.op12_tokenization_automaton(spark, C.write(spark, tmp_path / "none", documents=C.empty(spark))).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in A.decoded(rows, FILE).collect()] == ["", ""]
