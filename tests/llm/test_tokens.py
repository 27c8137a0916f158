"""The word-cached encoder against the tokenizer itself."""

import random
import unicodedata

import pytest
from public_tokenizers import path

from gridloom.llm.tokens import Encoder

FILE = path("word_bpe_49k.json")
#: Letters whose lower case is longer, marks, digits, stops, spaces of all kinds, and a sample of every script.
HARD = list("İIıßẞſǰΰ.,;:'\"-_ \t\n\x0b\x1c\x85\xa0\u2028\u3000\u0307\u0301aAzZ09é…。،") + ["\U0001d11e", "<|endoftext|>", "<|startoftext|>", ". ", ", "]
SCRIPTS = [chr(c) for c in range(33, 0x30000, 37) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


def check(encoder, texts):
    ids, lengths = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, lengths):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += n
    assert at == len(ids)


def test_dotted_capitals(encoder):
    check(encoder, ["A. İ. Yılmaz", "ALİ. x", "İ, x", "İ İ. İ,", "a. b, c", None, ""])


def test_fuzz(encoder):
    draw = random.Random(11)
    texts = ["".join(draw.choice(HARD if draw.random() < 0.7 else SCRIPTS) for _ in range(draw.randint(0, 24))) for _ in range(8000)]
    texts += [" ".join("".join(draw.choice(SCRIPTS) for _ in range(draw.randint(1, 6))) + draw.choice(["", ".", ",", ".,"]) for _ in range(12)) for _ in range(3000)]
    check(encoder, texts)
