"""Maximal periodic runs of words, by branching tandem repeats on the suffix tree of each document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, crc32_of, load, words_of
from .tokens import slices

#: Words that a run has at least; half of them repeat at the distance of its period.
LEAST = 12
#: Leaf and node pairs that are looked at together.
PAIRS = 1 << 21
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def repeating(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of LEAST / 2 words that occurs again in their document.

    A run of LEAST words or more is covered by such windows, so that all other words can be left out of the tree. Windows
    are compared by 64-bit hashes and looked up in a bit table; what they mistake for equal only makes the tree larger.
    """
    size, n = LEAST // 2, len(code)
    covered = np.zeros(n, bool)
    if n < size:
        return covered
    mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    word = mix(code.astype(np.uint64) + np.uint64(1)) ^ mix(mix(doc.astype(np.uint64) + np.uint64(7)))
    window = word[: n - size + 1].copy()
    for k in range(1, size):
        window = window * np.uint64(0xD6E8FEB86659FD93) + word[k : n - size + 1 + k]
    window = mix(window)
    within = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    ordered = np.sort(window[within])
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return covered
    bits = np.uint64(64 - 22)
    table = np.zeros(1 << 22, bool)
    table[again >> bits] = True
    hit = within[table[window[within] >> bits]]
    for k in range(size):
        covered[hit + k] = True
    return covered


class Tree:
    """The suffix tree of a string whose letters are numbers, as intervals of its sorted suffixes.

    A node of several children stands as a chain of binary nodes of one depth, so each place between two sorted suffixes is
    a node: ``depth`` letters are shared by the suffixes from ``low`` to ``high``, those up to the place on one side, the
    rest on the other. Suffixes are sorted by prefix doubling; the ranks of every doubling are kept to tell equal stretches.
    """

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        rank = np.unique(letters, return_inverse=True)[1].astype(np.int32)
        self.levels = [rank]
        while n and rank.max() + 1 < n:
            span = 1 << (len(self.levels) - 1)
            key = (rank.astype(np.int64) + 1) * (n + 1)
            key[: n - span] += rank[span:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
            self.levels.append(rank)
        self.rank = rank
        self.suffix = np.empty(n, np.int64)
        self.suffix[rank] = np.arange(n)
        self.depth = self.shared(self.suffix[:-1], self.suffix[1:])
        self.low, self.high = self.intervals(self.depth)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at a and at b share; they differ before the string ends."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a, b, out = a + step, b + step, out + step
        return out

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters before a and before b are the same; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            at = a - out - (1 << k)
            fits = at >= 0
            at = np.maximum(at, 0)
            out += (fits & (self.levels[k][at] == self.levels[k][at + (b - a)])).astype(np.int64) << k
        return out

    @staticmethod
    def intervals(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix around each place that share its depth at least."""
        low, high = [0] * len(depth), [len(depth)] * len(depth)
        open_: list[int] = []
        values = depth.tolist()
        for k, d in enumerate(values):
            while open_ and values[open_[-1]] > d:
                high[open_.pop()] = k
            low[k] = open_[-1] + 1 if open_ else 0
            open_.append(k)
        return np.array(low, np.int64), np.array(high, np.int64)

    def branching(self):
        """(start, period) of tandem repeats whose halves part after the second, in arrays.

        Of each node only the smaller side's leaves are listed, n log n in all: leaf i of depth d pairs with i + d and i - d if
        those are leaves of the other side.
        """
        node = np.flatnonzero(self.depth > 0)
        low, high, depth = self.low[node], self.high[node], self.depth[node]
        left, right = node + 1 - low, high - node
        smaller = np.minimum(left, right)
        first = np.where(left <= right, low, node + 1)
        other = np.where(left <= right, node + 1, low)
        last = np.where(left <= right, high, node)
        group = np.cumsum(smaller) // PAIRS if len(node) else smaller
        for g in np.unique(group):
            s = slice(*np.searchsorted(group, [g, g + 1]))
            n = smaller[s]
            leaf = np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, d, a, b = self.suffix[leaf], np.repeat(depth[s], n), np.repeat(other[s], n), np.repeat(last[s], n)
            for start, mate in ((i, i + d), (i - d, i - d)):
                ok = (mate >= 0) & (mate < len(self.rank))
                r = self.rank[np.where(ok, mate, 0)]
                ok &= (r >= a) & (r <= b)
                yield start[ok], d[ok]


def maximal_runs(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of LEAST words or more and two periods or more, by start and period.

    code: a number for each word; doc: the document of each, ascending. Runs keep to one document. Each run ends in one
    branching tandem repeat of its period; rotated left as far as its letters repeat, it is the run. Repeats of multiples
    of a period give the same stretch, of which the smallest period stays.
    """
    covered = repeating(code, doc)
    none = np.zeros(0, np.int64)
    place = np.flatnonzero(covered)
    if not len(place):
        return none, none, none
    # stretches of covered words, each with a letter of its own at its end; a word of two documents is two letters
    breaks = np.flatnonzero((np.diff(place) > 1) | (np.diff(doc[place]) > 0)) + 1
    letter = np.unique(doc[place] * (int(code.max()) + 1) + code[place], return_inverse=True)[1]
    ends = np.append(breaks, len(place))
    letters = np.insert(letter, ends, len(letter) + np.arange(len(ends)))
    origin = np.insert(place, ends, -1)
    tree = Tree(letters)
    found = []
    for start, period in tree.branching():
        back = tree.shared_before(start, start + period)
        length = back + 2 * period
        long = length >= LEAST
        found.append(np.stack([start[long] - back[long], length[long], period[long]]))
    start, length, period = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = origin[start[fresh]], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of_texts(texts: list[str | None]) -> tuple[list[list[dict]], list[str]]:
    """(runs, collapsed text) of each text."""
    words = [words_of(t) if t else [] for t in texts]
    number: dict[str, int] = {}
    for ws in words:
        for w in ws:
            if w not in number:
                number[w] = len(number)
    sizes = np.array([len(ws) for ws in words], np.int64)
    ends = np.cumsum(sizes)
    code = np.fromiter((number[w] for ws in words for w in ws), np.int64, ends[-1] if len(ends) else 0)
    doc = np.repeat(np.arange(len(words)), sizes)
    start, length, period = maximal_runs(code, doc)
    runs: list[list[dict]] = [[] for _ in texts]
    dropped = np.zeros(len(code) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped)[:-1] > 0
    firsts = ends - sizes
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()):
        d = int(doc[s])
        runs[d].append({"start": s - int(firsts[d]), "length": n, "period": p})
    out = []
    for ws, r, first in zip(words, runs, firsts.tolist()):
        if r:
            ws = [w for w, gone in zip(ws, dropped[first : first + len(ws)].tolist()) if not gone]
        out.append(" ".join(ws))
    return runs, out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed of every document of ``docs`` (doc_id, text; other columns, whatever their names, are ignored).

    runs: start, length and smallest period in words of every maximal run of 12 words and two periods or more, by start and
    period; several runs may start at one word (ties) and all are listed. collapsed: the words joined by one space, without those that
    stand in a run after its first period. Whole texts of any length; a null or empty text has no runs and collapses to
    an empty text; repeated rows are judged each on its own; an empty table gives no rows. No shuffle.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for a, b in slices(texts := batch.column(1).to_pylist(), 1 << 20):
                runs, collapsed = runs_of_texts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(runs, run_type), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth hash of doc_id with a tail that repeats: words from a on go on with period p."""
    h = crc32_of(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def tail(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    one = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, tail(ws)).otherwise(F.lit("")))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(one, F.lit(0))).otherwise(text)


def op11_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with the tails that the contract plants, as counts, the longest run and digests."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.withColumn("best", best)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
