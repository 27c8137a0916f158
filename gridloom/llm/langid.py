"""Language of each word by a linear-chain conditional random field.

A word's features are its affixes, character n-grams and the language lexicon it belongs to; the
field adds learned transitions between the languages of neighbouring words, so that code-switched
text gets a label per word. Forward-backward gives the words' marginals; a document has the language
of the greatest mean marginal.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, words_of, worker_cache
from .tokens import places, slices

#: Labelled documents to learn from (all languages together), languages to learn, words of one training sequence.
SAMPLE_DOCS, LANGUAGES, SEQUENCE = 1200, 256, 24
#: Hashed features; words of the lexicon of each language; passes over the training sequences, sequences of a step.
FEATURES, LEXICON, EPOCHS, STEP = 1 << 15, 3000, 3, 128
#: Tasks over which each language's texts spread before the sample is picked.
PARTS = 16
#: Characters of a word, and features of many, that are looked at in one go.
PIECE, GATHER = 1 << 16, 1 << 21
UNKNOWN = "und"
#: Distinct words that a worker remembers; words and lanes of one forward-backward run.
CACHE_WORDS, RUN_WORDS, LANES = 600_000, 400_000, 512


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    transition: np.ndarray  # labels x labels, log scale
    first: np.ndarray
    lexicon: dict[str, str]


def features(word: str, lexicon: dict[str, str]):
    """Hashed features of a word, in pieces: lexicon, affixes, and all 2- and 3-grams of the whole word in lower case."""
    w = word.lower()
    number = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES
    yield [number(x) for x in ("L" + lexicon.get(w, "?"), "1" + w[:1], "2" + w[:2], "3" + w[:3], "a" + w[-1:], "b" + w[-2:], "c" + w[-3:], "d" + w[-4:])]
    for at in range(0, len(w), PIECE):
        ends = range(at, min(at + PIECE, len(w)))
        yield [number("n" + w[i : i + 2]) for i in ends if i + 2 <= len(w)] + [number("m" + w[i : i + 3]) for i in ends if i + 3 <= len(w)]


def feature_rows(words: list[str], lexicon: dict[str, str]):
    """(feature numbers one word after the other, how many each word has): words without a letter have none, they take no side."""
    found = [[x for piece in features(w, lexicon) for x in piece] if has_letter(w) else [] for w in words]
    return np.fromiter((x for f in found for x in f), np.int32), np.array([len(f) for f in found], np.int64)


def summed(weights: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features."""
    out, some = np.zeros((len(lengths), weights.shape[1]), weights.dtype), lengths > 0
    if some.any():
        out[some] = np.add.reduceat(weights[flat], (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def word_scores(weights: np.ndarray, words: list[str], lexicon: dict[str, str]) -> np.ndarray:
    """Scores of words of any length: many short ones at once, the pieces of a long one after each other."""
    out, at = np.zeros((len(words), weights.shape[1]), weights.dtype), 0
    while at < len(words):
        to, size = at, 0
        while to < len(words) and size < GATHER and len(words[to]) <= PIECE:
            size += 8 + 2 * len(words[to])
            to += 1
        if to == at:
            if has_letter(words[at]):
                out[at] = sum(weights[piece].sum(0, dtype=np.float64) for piece in features(words[at], lexicon))
            to = at + 1
        else:
            out[at:to] = summed(weights, *feature_rows(words[at:to], lexicon))
        at = to
    return out


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def training_sequences(rows: list[tuple[str, str]], seed: int) -> list[list[tuple[str, str]]]:
    """Sequences of (word, language): each whole text in runs of words, half of them spliced with a run of
    another text, so that switches of language are seen."""
    draw = np.random.default_rng(seed)
    runs = []
    for text, lang in rows:
        words = words_of(text)
        runs += [[(w, lang) for w in words[at : at + SEQUENCE]] for at in range(0, len(words), SEQUENCE)]
    out = []
    for r in runs:
        if draw.random() < 0.5:
            other = runs[draw.integers(len(runs))]
            at, to = draw.integers(0, len(r) + 1), draw.integers(0, len(other) + 1)
            r = (r[:at] + other[to:])[:SEQUENCE] or r
        out.append(r)
    return out


def train(rows: list[tuple[str, str]], seed: int = 10) -> Field | None:
    """Fit the field to (text, lang) rows by AdaGrad on the conditional likelihood."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    sequences = training_sequences(rows, seed)
    counts = {lang: Counter() for lang in labels}
    for s in sequences:
        for w, lang in s:
            counts[lang][w.lower()] += 1
    owner = Counter()
    for lang in labels:
        owner.update(counts[lang])
    lexicon = {w: lang for lang in labels for w, n in counts[lang].most_common(LEXICON) if n >= 3 and n >= 0.8 * owner[w]}
    k, number = len(labels), {lang: i for i, lang in enumerate(labels)}
    flat, count = feature_rows(list(owner), lexicon)
    first_of, place = np.cumsum(count) - count, {w: i for i, w in enumerate(owner)}
    n = len(sequences)
    words, gold, length = np.zeros((n, SEQUENCE), np.int64), np.zeros((n, SEQUENCE), np.int64), np.array([len(s) for s in sequences])
    for i, s in enumerate(sequences):
        words[i, : len(s)] = [place[w.lower()] for w, _ in s]
        gold[i, : len(s)] = [number[lang] for _, lang in s]
    weights, trans, first = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    speed = [np.full(x.shape, 1e-2) for x in (weights, trans, first)]
    draw = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        order = draw.permutation(n)
        for at in range(0, n, STEP):
            b = order[at : at + STEP]
            live = np.arange(SEQUENCE) < length[b][:, None]
            w = words[b][live]
            c = count[w]
            used = flat[np.repeat(first_of[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            score = np.zeros((*live.shape, k))
            score[live] = summed(weights, used, c)
            node, edge, start = gradient(score, trans, first, gold[b], live)
            pull = np.repeat(node[live], c, axis=0)
            g = np.stack([np.bincount(used, pull[:, j], FEATURES) for j in range(k)], 1)
            for x, d, s in zip((weights, trans, first), (g, edge, start), speed):
                d = d / len(b) - 1e-5 * x
                s += d**2
                x += 0.5 * d / np.sqrt(s)
    return Field(labels, weights.astype(np.float32), trans, first, lexicon)


def gradient(score, trans, first, gold, live):
    """Observed less expected node labels, transitions and first labels of a batch of sequences."""
    b, t, k = score.shape
    e, m = np.exp(score - score.max(2, keepdims=True)), np.exp(trans - trans.max())
    alpha, beta = np.empty((t, b, k)), np.ones((t, b, k))
    alpha[0] = e[:, 0] * np.exp(first - first.max())
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[i - 1] @ m) * e[:, i]
        alpha[i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        a = (e[:, i + 1] * beta[i + 1]) @ m.T
        beta[i] = np.where(live[:, i + 1, None], a / a.sum(1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    truth = np.eye(k)[gold]
    node = (truth - gamma.transpose(1, 0, 2)) * live[..., None]
    edge = np.zeros((k, k))
    for i in range(1, t):
        xi = alpha[i - 1][:, :, None] * m * (e[:, i] * beta[i])[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        on = live[:, i]
        edge += (truth[on, i - 1][:, :, None] * truth[on, i][:, None, :]).sum(0) - xi[on].sum(0)
    return node, edge, node[:, 0].sum(0)


def marginals(score: np.ndarray, starts: np.ndarray, field: Field) -> np.ndarray:
    """Label marginals of many documents' words, one after the other; starts marks first words.

    All documents form one chain that forgets its past at each start. The chain is laid out in lanes:
    the product of a lane's transfer matrices carries the state to the next lane, then every lane
    runs forward and backward at once.
    """
    n, k = score.shape
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    pad = lanes * steps - n
    e = np.exp(score - score.max(1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(lanes, steps, k)
    new = np.concatenate([starts, np.ones(pad, bool)]).reshape(lanes, steps)
    m, first = np.exp(field.transition - field.transition.max()), np.exp(field.first - field.first.max())
    fresh = np.tile(first, (k, 1))  # from any label, to a first word

    def unit(x, axes):
        return x / x.sum(axes, keepdims=True)

    def into(i):
        return np.where(new[:, i, None, None], fresh, m)

    product = np.tile(np.eye(k), (lanes, 1, 1))
    for i in range(steps):
        product = unit(product @ (into(i) * e[:, i, None, :]), (1, 2))
    before, after = np.empty((lanes, k)), np.empty((lanes, k))
    state = np.full(k, 1 / k)
    for lane in range(lanes):
        before[lane] = state
        state = unit(state @ product[lane], 0)
    state = np.full(k, 1 / k)
    for lane in range(lanes - 1, -1, -1):
        after[lane] = state
        state = unit(product[lane] @ state, 0)
    alpha = np.empty((steps, lanes, k))
    state = before
    for i in range(steps):
        moved = np.where(new[:, i, None], state.sum(1, keepdims=True) * first, state @ m)
        state = alpha[i] = unit(moved * e[:, i], 1)
    state = after
    for i in range(steps - 1, -1, -1):
        alpha[i] = unit(alpha[i] * state, 1)
        back = e[:, i] * state
        state = unit(np.where(new[:, i, None], (back * first).sum(1, keepdims=True), back @ m.T), 1)
    return alpha.transpose(1, 0, 2).reshape(-1, k)[:n]


class Labeller:
    """A field with the scores of the words that it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self):
        self.index, self.scores, self.letters = {}, np.empty((0, len(self.field.labels)), np.float32), np.empty(0, bool)

    def learn(self, fresh):
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
            self.scores = np.concatenate([self.scores, word_scores(self.field.weights, part, self.field.lexicon)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(has_letter, part), bool, len(part))])

    def words(self, texts):
        """(marginals of all words, whether each has a letter, words of each text)."""
        split = [words_of(t) if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        at = places(self.index, words, self.learn)
        lengths = np.array([len(ws) for ws in split], np.int64)
        starts = np.zeros(len(words), bool)
        starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return (marginals(self.scores[at].astype(np.float64), starts, self.field) if len(words) else np.empty((0, len(self.field.labels)))), self.letters[at], lengths

    def documents(self, texts):
        """(language, score) of each text."""
        gamma, letters, lengths = self.words(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)[letters]
        gamma = gamma[letters]
        n = np.bincount(owner, minlength=len(texts))
        mean = np.stack([np.bincount(owner, g, len(texts)) for g in gamma.T], 1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        return [self.field.labels[b] if c else UNKNOWN for b, c in zip(best, n)], np.where(n > 0, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0)


def fit(labelled: DataFrame, limit: int = SAMPLE_DOCS) -> Field | None:
    """Fit on at most ``limit`` whole documents of (doc_id, text, lang), spread over the languages.

    Every language (the LANGUAGES most frequent ones) has an equal share of the sample: those of its
    different texts whose hashes are least, so that copies count once. Only their ids are picked
    from the whole table; then ``limit`` texts at most reach the driver. Rows with a null text or
    lang are passed over. Without rows there is no field.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), "doc_id", "text")
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(LANGUAGES, limit)).collect()]
    if not langs:
        return None
    texts = rows.where(F.col("lang").isin(langs)).groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    least = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("rank") <= limit // len(langs)).drop("rank")
    texts = least(texts.withColumn("part", F.pmod("h", F.lit(PARTS))), "lang", "part")  # a language's texts spread over tasks first
    picked = least(texts, "lang").select("lang", "h", F.col("doc_id").alias("picked_id"))
    picked = labelled.sparkSession.createDataFrame(picked.collect(), picked.schema)  # ``limit`` ids at most
    found = rows.join(F.broadcast(picked), ["lang", "h"]).where(F.col("doc_id").eqNullSafe(F.col("picked_id"))).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return train([(r["text"], r["lang"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"]))])


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text; other columns are not read).

    A text that is null or has no letter gets ``und`` and score 0, and so do all if there is no
    field; of equal means the language first in code point order wins. Whole texts are labelled,
    however long they or their words are, in runs of many documents. Repeated rows each get their
    row; an empty table gives an empty result. No shuffle.
    """

    def run(batches):
        if field is None:
            labeller = None
        else:
            cache = worker_cache("labellers")
            key = zlib.crc32(field.weights.tobytes())
            if key not in cache:
                cache.clear()
                cache[key] = Labeller(field)
            labeller = cache[key]
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                langs, scores = labeller.documents(texts[a:b]) if labeller else ([UNKNOWN] * (b - a), np.zeros(b - a))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, words (array of word, lang, score): the language of every word of every text."""

    def run(batches):
        labeller = Labeller(field)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                gamma, letters, lengths = labeller.words(texts[a:b])
                ends = np.cumsum(lengths)
                out = []
                for t, lo, hi in zip(texts[a:b], ends - lengths, ends):
                    best = gamma[lo:hi].argmax(1)
                    out.append([{"word": w, "lang": field.labels[c] if has else UNKNOWN, "score": float(g[c])} for w, c, g, has in zip(words_of(t or ""), best, gamma[lo:hi], letters[lo:hi])])
                kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(out, kind)], ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    field = fit(docs.where(~held_out))
    found = predict(docs, field)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
