"""Word-cached encoding with a public tokenizer, inside Python workers."""

from __future__ import annotations

import os
import re
from itertools import islice, repeat

import numpy as np

from .common import words_of, worker_cache

#: Distinct words, and characters of them, that a worker remembers before it forgets the later half.
CACHE_WORDS, CACHE_CHARS = 500_000, 10_000_000
#: A stop or comma after an ASCII letter and before white space: a token of its own, here a word of its own. Other letters
#: may end in a combining mark once in lower case, which joins the stop.
_STOP, _COMMA = (re.compile(rf"{c}(?<=[A-Za-z].)(?=[\x20\x09-\x0D])") for c in (r"\.", ","))


class Encoder:
    """Encodes many texts at once; every distinct word meets the tokenizer once while it is cached.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words, one after the other. tests/llm/test_tokens.py holds this against the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)  # word i has flat[first[i]:first[i + 1]]

    def forget(self) -> None:
        """Keep the words met first: frequent words are among them."""
        n = len(self.index) // 2
        self.index = dict(islice(self.index.items(), n))
        self.chars = sum(map(len, self.index))
        self.first = self.first[: n + 1]
        self.flat = self.flat[: self.first[-1]]

    def learn(self, fresh: list[str]) -> None:
        plain = [w for w in fresh if w.isalpha() and len(w) < 64]
        for at in range(0, len(plain), 5_000):  # letters alone are one word to the tokenizer, however many go in at once
            part = plain[at : at + 5_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                self.keep(part, ids, np.diff(ends, prepend=0))
        fresh = [w for w in fresh if w not in self.index]
        for at in range(0, len(fresh), 5_000):
            part = fresh[at : at + 5_000]
            found = [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            self.keep(part, np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        base = len(self.index)
        self.index.update(zip(words, range(base, base + len(words))))
        self.chars += sum(map(len, words))
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])

    @staticmethod
    def split(text: str) -> list[str]:
        """Words to encode: the tokenizer lower-cases, which for ASCII may as well be done before."""
        text = text.lower() if text.isascii() else text
        return words_of(_COMMA.sub(" ,", _STOP.sub(" .", text)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        at = places(self.index, words, self.learn)
        lengths = self.first[at + 1] - self.first[at] if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.first[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)] if len(at) else np.empty(0, np.uint32)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)])]
        return ids, np.diff(bounds)


def places(index: dict[str, int], words: list[str], learn) -> np.ndarray:
    """index[w] of each word, after learn() has put the missing ones, each once, into the index."""
    at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(at < 0)
    if len(missing):
        absent = [words[i] for i in missing.tolist()]
        learn(list(dict.fromkeys(absent)))
        at[missing] = np.fromiter(map(index.__getitem__, absent), np.int64, len(absent))
    return at


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def slices(texts: list, chars: int = 1 << 21):
    """Ranges of consecutive texts of about so many characters, so that a batch's memory is bounded."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= chars:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
