"""Byte-level BPE as a deterministic automaton over tokens, compiled merge by merge.

The first automaton has one state and an arc for each byte. The gadget of a merge (u, v) -> w gives u a state of its own, a
copy of the one before without the arc v, and adds an arc w beside each arc u, to where v led. A path then spells exactly the
tokenization that the merges give, so each prefix of a word has one path and a word is read left to right.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, worker_cache
from .tokens import slices

#: Unicode's white space, as the pre-tokenizer takes it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Letters that make a word whatever stands around them, if no other character beyond ASCII follows.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN = re.compile(f" ?[{_LATIN}]+")
#: Pieces that no token crosses: a word of such letters with one space before it, what else stands between white space,
#: white space up to the last before a word, that last one.
PIECE = re.compile(f" ?[{_LATIN}]++(?![^\x00-\x7f])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
#: Distinct pieces and characters of them, and pairs of tokens, that a worker remembers before it forgets.
CACHE_PIECES, CACHE_CHARS, CACHE_ARCS = 600_000, 16_000_000, 2_000_000
#: Pieces longer than this are encoded anew each time.
LONGEST = 256
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Labels(dict):
    """The bytes on the arc of each token; ids without an arc have none."""

    def __missing__(self, _) -> bytes:
        return b""


def arc_labels(spec: dict) -> Labels:
    letters = byte_letters()
    return Labels({i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]})


def spell(labels: Labels, ids) -> str:
    """The bytes that the arcs carry, as text; what is not UTF-8 becomes U+FFFD."""
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def read_file(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)


class Automaton:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library.

    A token's state differs from the one that it was copied from by one missing arc, so all states are kept as the steps
    at which arcs went: ``gone[u, v]`` is the step of the merge that took v from u's state. A merged token takes over the
    state of its right half, and its arc leaves wherever its left half's arc did.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = read_file(file)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE without prefix space and normalizer")
        self.split = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need whole words")
        self.added = added
        self.cut_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).finditer if added else None
        self.labels = arc_labels(spec)
        self.made: dict[int, tuple[int, int, int]] = {}
        self.gone: dict[tuple[int, int], int] = {}
        live = {vocab[c]: None for c in letters if c in vocab}
        if len(live) < 256:
            raise ValueError("a byte without a token")
        for step, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in live or v not in live or not self.follows(u, v):
                continue  # no path has u before v, so the gadget adds nothing
            if w in live:
                raise ValueError("two merges make one token")
            self.gone[u, v] = step
            self.made[w] = (u, v, step)
            live[w] = None
        self.build_reader(list(live))
        self.arcs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def follows(self, u: int, v: int) -> bool:
        """Whether the state after u has an arc v."""
        made, gone = self.made, self.gone
        left, before = u, NEVER  # arcs that the state of ``left`` lost before that step are missing after u as well
        while True:
            right, until = v, NEVER  # and so is all that would have been built on an arc after it had gone
            while True:
                step = gone.get((left, right))
                if step is not None and step < before and step <= until:
                    return False
                if right not in made:
                    break
                right, _, until = made[right]
            if left not in made:
                return True
            _, left, before = made[left]

    def build_reader(self, live: list[int]) -> None:
        """For each place of a word the longest token that ends there, and from a token to the next shorter one."""
        self.step: dict[int, int] = {}  # node << 8 | byte -> node
        ends, nodes = {}, [(0, 0, 0)]
        for i in live:
            node = 0
            for b in self.labels[i]:
                if (to := self.step.get(node << 8 | b)) is None:
                    to = self.step[node << 8 | b] = len(nodes)
                    nodes.append((node, b, nodes[node][2] + 1))
                node = to
            ends[node] = i
        self.fail, self.longest, self.shorter = [0] * len(nodes), [-1] * len(nodes), {}
        for node in sorted(range(1, len(nodes)), key=lambda k: nodes[k][2]):
            parent, b, _ = nodes[node]
            fail = self.fail[node] = self.next(self.fail[parent], b) if parent else 0
            self.longest[node] = ends.get(node, self.longest[fail])
            if node in ends:
                self.shorter[ends[node]] = self.longest[fail]
        self.size = {i: len(self.labels[i]) for i in live}

    def next(self, node: int, b: int) -> int:
        """The node of the longest string that ends at the next byte."""
        to = self.step.get(node << 8 | b)
        while to is None and node:
            node = self.fail[node]
            to = self.step.get(node << 8 | b)
        return to or 0

    def read(self, word: bytes) -> list[int]:
        """The tokens of a word, by one pass over its bytes: of the tokens that end at a place one alone has an arc there."""
        last = [-1] * (len(word) + 1)
        arcs, step, longest, shorter, size = self.arcs, self.step, self.longest, self.shorter, self.size
        node = at = 0
        for b in word:
            at += 1
            to = step.get(node << 8 | b)
            node = self.next(node, b) if to is None else to
            token = longest[node]
            while (before := last[at - size[token]]) >= 0:
                arc = arcs.get(before << 32 | token)
                if arc is None:
                    if len(arcs) > CACHE_ARCS:
                        arcs.clear()
                    arc = arcs[before << 32 | token] = self.follows(before, token)
                if arc:
                    break
                token = shorter[token]
            last[at] = token
        out = []
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        """Tokens of a piece, which is split into words as the library does."""
        if LATIN.fullmatch(text):
            found = tuple(self.read(text.encode()))
        else:
            found = tuple(i for _, (a, b) in self.split(text) for i in self.read(text[a:b].encode()))
        if len(text) <= LONGEST:
            if len(self.known) >= CACHE_PIECES or self.chars >= CACHE_CHARS:  # keep what was met first: frequent pieces are among it
                self.known = dict(islice(self.known.items(), len(self.known) // 2))
                self.chars = sum(map(len, self.known))
            self.known[text] = found
            self.chars += len(text)
        return found

    def plain(self, text: str) -> list[int]:
        pieces = PIECE.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            get, learn = self.known.get, self.piece
            found = [t if t is not None else get(p) or learn(p) for t, p in zip(found, pieces)]
            # learn() may replace self.known; a piece that it has forgotten is learnt again
        return list(chain.from_iterable(found))

    def encode(self, text: str) -> list[int]:
        if self.cut_added is None or not any(map(text.__contains__, self.added)):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut_added(text):
            out += self.plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.plain(text[at:])


def automaton(file: str) -> Automaton:
    """The worker's automaton for a vocabulary file."""
    cache = worker_cache("automata")
    if file not in cache:
        cache[file] = Automaton(file)
    return cache[file]


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text of ``docs`` (doc_id, text; other columns, whatever their names, are ignored).

    A null or empty text has no ids. Strings of added tokens in a text get those tokens' ids, as in the library. Repeated
    rows are encoded each on its own; a text of any length is read in time linear to it. No shuffle.
    """

    def run(batches):
        table = automaton(file)
        for batch in batches:
            for a, b in slices(texts := batch.column(1).to_pylist()):
                ids = [table.encode(t) if t else [] for t in texts[a:b]]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, file: str) -> DataFrame:
    """``rows`` (doc_id, ids, nothing else) with ``decoded``, the text that the ids spell: null ids and none give an empty text."""

    def run(batches):
        labels = arc_labels(read_file(file))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [spell(labels, i.values.to_numpy(zero_copy_only=False).tolist()) if i.is_valid else "" for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, rows.select("doc_id", "ids").schema.add("decoded", "string"))


def op12_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests. Edge cases as in encoded() and decoded(); an empty table gives no rows."""
    file = vocabulary("byte_bpe_50k.json")
    rows = decoded(encoded(load(spark, sf_dir, "documents"), file), file)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
