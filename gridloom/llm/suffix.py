"""Removal of long repeated byte strings by distributed prefix doubling on sampled positions.

Two equal strings of LENGTH bytes also agree in where their least SEED-byte string stands (by hash).
Those anchors are sampled positions: about one in forty, at the same places in equal text.

1. Spark ranks the anchors by the SEED bytes they start with. An anchor of a rank of its own has no
   repeated string around it, and is dropped: most text ends here.
2. An anchor serves a run of consecutive start positions. Spark sorts the anchors by the whole bytes
   of their runs: of equal runs all but the earliest repeat, start for start.
3. The different runs that are left of a rank are doubled: positions are ranked by SEED bytes, then
   by pairs of ranks at offsets SEED, 2 SEED, ... up to LENGTH, each time without the unique ones. Of
   equal ranks at LENGTH all but the earliest position repeat. These rounds run within tasks, each
   with the runs of many whole ranks at a time, not as Spark sorts.
4. A rank of more than CROWD different runs is no task's: its runs are ranked anew by the bytes before
   the seed and by those after it. Ranks that are crowded even then are taken apart into positions,
   which Spark groups by the pair of ranks of their two halves.

Whatever is dealt by a rank has first been brought down to one row a batch or partition, so a seed, run
or passage that a third of all rows hold is not one task's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load, materialize, worker_cache

#: LENGTH must be SEED times a power of two.
LENGTH, SEED = 100, 25
#: Bytes handled at once; longer texts are cut into overlapping segments. Most runs of a rank, and bytes of
#: a batch, that are doubled within a task.
SLICE, CROWD, BATCH = 1 << 21, 4096, 1 << 20
BASE = 0x9E3779B97F4A7C15
#: q, q - lo and q - hi of an anchor's run share a long.
SMALL, MASK = 7, 127
#: Bytes before a seed by which a crowded rank is made finer; the other way is by those after it.
LEFT, MASK64 = (LENGTH - SEED) // 2, (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    cache = worker_cache("powers")
    if len(cache.get(base, ())) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        k = 1
        while k < len(out):
            m = min(k, len(out) - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        cache[base] = out
    return cache[base]


class Rolling:
    """Fingerprints of all substrings of a byte string."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, down = powers(BASE, n + 1), powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=self.sums[1:])

    def of(self, start, end, salt: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.up[start]
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    rest = width - w
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(segments: list[bytes]):
    """Of the concatenated segments: anchor, first and last start position of each run, its segment,
    the fingerprints of its seed and of all its bytes. No string crosses a segment's end."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    roll = Rolling(data)
    at = np.arange(max(0, len(data) - SEED + 1))
    seed = roll.of(at, at + SEED)
    code = (seed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = sliding_least(code, LENGTH - SEED + 1) if len(code) > LENGTH - SEED else code[:0]
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[owner])
    if not len(start):
        return None
    q, owner = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (q[1:] != q[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    q = q[first]
    return q, lo, hi, owner[first], seed[q], roll.of(lo, hi + LENGTH, salt=1) + ((q - lo) * 128 + (q - hi)).astype(np.uint64)


#: Partitions and rows of a partition share a document's number.
PART = 40


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, copies, z: the different (doc_id, text) pairs with how often each stands, texts compressed.

    doc numbers the pairs in order of doc_id, null first, then of a digest of both. Equal pairs are
    brought together before the sort, so neither a doc_id nor a pair that many rows share is one task's.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"), 256))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("key"), text.alias("text"))

    def number(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << PART
        for batch in batches:
            doc = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), doc, batch.column(1), batch.column(2)], ["key", "doc", "doc_id", "copies"])

    def squeeze(batches):
        import zstandard

        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = [squeezer.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary())], ["key", "z"])

    pairs = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("copies"))
    ordered = pairs.select("key", "doc_id", "copies").repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    numbers = materialize(ordered.mapInArrow(number, "key binary, doc long, doc_id long, copies long"))
    texts = keyed.select("key", "text").mapInArrow(squeeze, "key binary, z binary").groupBy("key").agg(F.first("z").alias("z"))
    return materialize(texts.join(numbers, "key").select("doc", "doc_id", "copies", "z"))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """kind, h, u, doc, run of numbered documents: every anchor (kind 0); of equal runs read together, the later ones are
    known to repeat already (kind 1)."""

    def rows(segments, owners):
        found = anchors(segments)
        if found is None:
            return None
        q, lo, hi, seg, h, u = found
        ends = np.cumsum([len(s) for s in segments])
        origin = np.array([base for _, base in owners]) - (ends - np.array([len(s) for s in segments]))
        doc = np.array([d for d, _ in owners], np.int64)[seg]
        run = ((q + origin[seg]) << (2 * SMALL)) | ((q - lo) << SMALL) | (q - hi)
        order = np.lexsort((run, doc, u, h))
        h, u, doc, run = h[order], u[order], doc[order], run[order]
        known = np.zeros(len(h), np.int32)
        head = heads(h, u)
        known[(doc != doc[head]) | (run != run[head])] = REPEAT
        h, u = (np.where(known == REPEAT, np.uint64(0), x) for x in (h, u))  # not asked for any more, and zeros take no room
        return pa.RecordBatch.from_arrays([pa.array(known), pa.array(h.view(np.int64)), pa.array(u.view(np.int64)), pa.array(doc), pa.array(run)], ["kind", "h", "u", "doc", "run"])

    def scan(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor()
        segments, owners, size = [], [], 0
        for batch in batches:
            for doc, z in zip(batch.column(0), batch.column(1)):
                data = unsqueeze.decompress(z.as_py())
                for base in range(0, max(1, len(data) - LENGTH + 1), SLICE):
                    part = data[base : base + SLICE + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    segments.append(part)
                    owners.append((doc.as_py(), base))
                    size += len(part)
                    if size >= SLICE:
                        out = rows(segments, owners)
                        if out is not None:
                            yield out
                        segments, owners, size = [], [], 0
        if segments and (out := rows(segments, owners)) is not None:
            yield out

    return docs.select("doc", "z").mapInArrow(scan, "kind int, h long, u long, doc long, run long")


def heads(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, where the group of equal keys begins that each belongs to."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def beside(h: np.ndarray) -> np.ndarray:
    """Which of sorted values have an equal one next to them."""
    same = h[1:] == h[:-1]
    return np.append(same, False) | np.append(False, same) if len(h) else np.zeros(0, bool)


RANKED = "kind int, h long, doc long, run long"
#: Kinds of ranked rows: a lead whose rank is not known to have other runs, a run that repeats an earlier one,
#: a lead whose rank has others, and a rank that has several leads in some partition.
LEAD, REPEAT, OPEN, MET = range(4)


def ranked_rows(kind: int, h, doc, run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *map(pa.array, (h, doc, run))], ["kind", "h", "doc", "run"])


def leads(rows: DataFrame) -> DataFrame:
    """The earliest of all equal runs as LEAD or OPEN, the others as REPEAT, and a row MET for each rank with OPEN ones.

    Rows are dealt by rank and bytes and stream by in order of both and place; the last lead is held
    back until another comes. Leads of a rank that lie in one partition need not meet any more.
    """

    def stream(batches):
        held, company = None, False  # the last lead, and whether its rank has others here
        for batch in batches:
            kind, h, u, doc, run = (batch.column(i).to_numpy() for i in range(5))
            done = kind == REPEAT
            yield ranked_rows(REPEAT, 0 * h[done], doc[done], run[done])
            h, u, doc, run = (x[~done] for x in (h, u, doc, run))
            if not len(h):
                continue
            if held is not None:
                h, u, doc, run = (np.append(a, b) for a, b in zip(held, (h, u, doc, run)))
            head = heads(h, u)
            later = (doc != doc[head]) | (run != run[head])
            yield ranked_rows(REPEAT, 0 * h[later], doc[later], run[later])
            lead = np.unique(head)
            several = beside(h[lead])
            several[0] |= company
            held, company = [x[lead[-1:]] for x in (h, u, doc, run)], bool(several[-1])
            lead, several = lead[:-1], several[:-1]
            for kind, at in ((OPEN, lead[several]), (LEAD, lead[~several])):
                yield ranked_rows(kind, h[at], doc[at], run[at])
            met = np.unique(h[lead[several]])
            yield ranked_rows(MET, met, np.zeros_like(met), np.zeros_like(met))
        if held is not None:
            yield ranked_rows(OPEN if company else LEAD, held[0], held[2], held[3])

    where = F.when(F.col("kind") == REPEAT, F.xxhash64("doc", "run")).otherwise(F.xxhash64("h", "u"))  # known repeats need not meet
    return rows.repartition(where).sortWithinPartitions("h", "u", "doc", "run").mapInArrow(stream, RANKED)


def rerank(rows: DataFrame) -> DataFrame:
    """kind, h, doc, run: runs that repeat an earlier one (REPEAT, h being 0), and the earliest of each of the
    different runs of a rank that has several (OPEN). Anchors of unique rank are gone.

    At most one lead or MET row of a rank comes from a batch of a partition, so a common seed is not one task's.
    """

    def stream(batches):
        held, company = None, False  # the last row that waits for its rank's others
        for batch in batches:
            kind, h, doc, run = (batch.column(i).to_numpy() for i in range(4))
            for known in (REPEAT, OPEN):
                at = kind == known
                yield ranked_rows(known, h[at], doc[at], run[at])
            wait = (kind == LEAD) | (kind == MET)
            rows = [x[wait] for x in (kind, h, doc, run)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(a, b) for a, b in zip(held, rows)]
            several = beside(rows[1])
            several[0] |= company
            held, company = [x[-1:] for x in rows], bool(several[-1])
            at = (several & (rows[0] == LEAD))[:-1]
            yield ranked_rows(OPEN, *(x[:-1][at] for x in rows[1:]))
        if held is not None and company and held[0][0] == LEAD:
            yield ranked_rows(OPEN, *held[1:])

    where = F.when(F.col("kind").isin(LEAD, MET), F.col("h")).otherwise(F.xxhash64("doc", "run"))
    return leads(rows).repartition(where).sortWithinPartitions("h").mapInArrow(stream, RANKED)


def run_bytes(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """finer, h, doc, run, bytes: the open runs with what they cover; those of crowded ranks under their finer ranks."""
    crowds = cut(open_runs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))  # so that the join splits
    flagged = open_runs.join(crowds.hint("merge"), "h", "left").select("doc", F.struct("h", "run", F.col("n").isNotNull().alias("crowded")).alias("r"))
    by_doc = flagged.groupBy("doc").agg(F.collect_list("r").alias("runs"))  # as many as a text has room for

    def read(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [], [], [], [], []
            for doc, z, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = unsqueeze.decompress(z.as_py())
                for r in runs:
                    q, left, right = place(r["run"])
                    piece = data[q - left : q - right + LENGTH]
                    for h in halves(r["h"], r["run"], piece) if r["crowded"] else (r["h"],):
                        for column, v in zip(out, (r["crowded"], h, doc, r["run"], piece)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array(out[4], pa.binary())], ["finer", "h", "doc", "run", "bytes"])

    return docs.select("doc", "z").join(by_doc, "doc").select("doc", "z", "runs").mapInArrow(read, "finer boolean, h long, doc long, run long, bytes binary")


def place(run):
    """q, q - lo, q - hi of a run."""
    return run >> (2 * SMALL), (run >> SMALL) & MASK, run & MASK


def unrepeated(rank: np.ndarray) -> np.ndarray:
    """Which ranks stand only once."""
    return np.bincount(rank)[rank] == 1 if len(rank) else np.zeros(0, bool)


def double_within(doc: np.ndarray, run: np.ndarray, pieces: list[bytes]):
    """doc, lo, hi: start positions of the runs whose LENGTH bytes start earlier in another.

    All runs of a rank are among the rows. Ranks of SEED bytes come from fingerprints; each round
    ranks the pairs of a position and the one the current length further.
    """
    sizes = np.array([len(p) for p in pieces])
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(pieces), np.uint8)
    roll, at = Rolling(data), np.arange(max(0, len(data) - SEED + 1))
    rank = np.unique(roll.of(at, at + SEED), return_inverse=True)[1]
    starts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(pieces)), starts)
    pos = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + first[row]
    length = SEED
    while length < LENGTH:
        pair = rank[: len(rank) - length] * np.int64(len(rank) + 1) + rank[length:]
        rank = np.unique(pair, return_inverse=True)[1]
        length *= 2
        among = rank[pos]
        keep = ~unrepeated(among)
        row, pos = row[keep], pos[keep]
    q, left, _ = place(run)
    where = (q - left)[row] + pos - first[row]
    order = np.lexsort((where, doc[row], rank[pos]))
    r, d, w = rank[pos][order], doc[row][order], where[order]
    head = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(r)), 0)) if len(r) else order
    later = (d != d[head]) | (w != w[head])
    return intervals(d[later], w[later])


def intervals(doc, where):
    """doc, lo, hi of the maximal runs of consecutive positions."""
    order = np.lexsort((where, doc))
    d, w = doc[order], where[order]
    new = np.append(True, (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)) if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(d) else first
    return d[first], w[first], w[last]


def halves(h: int, run: int, piece: bytes):
    """The ranks among which a run of a crowded rank meets all others that share a string with it.

    Strings of LENGTH bytes around equal seeds also agree in LEFT bytes before the seed, or in what
    LEFT leaves of LENGTH after it.
    """
    at = int(place(run)[1])
    end = at + LENGTH - LEFT
    if at >= LEFT:
        yield signed(xxhash.xxh3_64_intdigest(piece[at - LEFT : at], h & MASK64))
    if len(piece) >= end:
        yield signed(xxhash.xxh3_64_intdigest(piece[at + SEED : end], ~h & MASK64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SPANS = "doc long, lo long, hi long"


def double_few(runs: DataFrame) -> DataFrame:
    """doc, lo, hi: start positions that repeat an earlier one, of runs whose ranks have at most CROWD."""

    def stream(batches):
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for i in range(4):
                held[i] += batch.column(i).to_pylist()
            last = len(held[0])
            while last and held[0][last - 1] == held[0][-1]:
                last -= 1  # the last rank may go on
            if last and sum(map(len, held[3])) >= BATCH:
                yield spans(*double_within(np.array(held[1][:last]), np.array(held[2][:last]), held[3][:last]))
                held = [x[last:] for x in held]
        if held[0]:
            yield spans(*double_within(np.array(held[1]), np.array(held[2]), held[3]))

    def spans(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc", "lo", "hi"])

    ordered = runs.select("h", "doc", "run", "bytes").repartition("h").sortWithinPartitions("h", "doc", "run")
    return ordered.mapInArrow(stream, SPANS)


def double_crowds(runs: DataFrame) -> DataFrame:
    """doc, lo, hi: start positions of crowded ranks' runs that repeat an earlier one, each by itself.

    Equal strings of a batch are brought down to the earliest; those of all batches meet by the ranks of both halves.
    """

    def stream(batches):
        for batch in batches:
            doc, run, pieces = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.array([len(p) for p in pieces], np.int64)
            first, starts = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
            row = np.repeat(np.arange(len(pieces)), starts)
            pos = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + first[row]
            roll = Rolling(np.frombuffer(b"".join(pieces), np.uint8))
            q, left, _ = place(run)
            d, w = doc[row], (q - left)[row] + pos - first[row]
            a, b = (x.view(np.int64) for x in (roll.of(pos, pos + LENGTH // 2), roll.of(pos + LENGTH // 2, pos + LENGTH, salt=2)))
            order = np.lexsort((w, d, b, a))
            a, b, d, w = (x[order] for x in (a, b, d, w))
            head = heads(a, b)
            later = (d != d[head]) | (w != w[head])
            lead = np.unique(head)
            for known, at in ((True, later), (False, lead)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[at]), known)), *(pa.array(x[at]) for x in (a, b, d, w))], ["known", "a", "b", "doc", "lo"])

    found = materialize(runs.select("doc", "run", "bytes").mapInArrow(stream, "known boolean, a long, b long, doc long, lo long"))
    many = found.where("not known")
    earliest = cut(many.groupBy("a", "b").agg(F.min(F.struct("doc", "lo")).alias("e"), F.count("*").alias("n")).where("n > 1").select("a", "b", "e"))  # so that the join splits
    later = many.join(earliest.hint("merge"), ["a", "b"]).where(F.struct("doc", "lo") != F.col("e"))
    return found.where("known").select("doc", "lo", F.col("lo").alias("hi")).unionByName(later.select("doc", "lo", F.col("lo").alias("hi")))


def doubled(runs: DataFrame) -> DataFrame:
    """doc, lo, hi: start positions in the open runs that repeat an earlier one."""
    runs = materialize(runs)
    finer = runs.where("finer")
    counts = cut(finer.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))  # unique ones are done
    finer = finer.join(counts.hint("merge"), "h")
    few = runs.where("not finer").unionByName(finer.where(F.col("n") <= CROWD).drop("n"))
    return double_few(few).unionByName(double_crowds(finer.where(F.col("n") > CROWD)))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc, lo, hi: the LENGTH-byte strings starting at lo to hi of a numbered document start earlier too."""
    ranked = materialize(rerank(anchor_rows(docs)))
    q, left, right = place_sql()
    whole = ranked.where(F.col("kind") == REPEAT).select("doc", (q - left).alias("lo"), (q - right).alias("hi"))
    return whole.unionByName(doubled(run_bytes(docs, ranked.where(F.col("kind") == OPEN))))


def place_sql():
    run = F.col("run")
    return F.shiftright(run, 2 * SMALL), F.shiftright(run, SMALL).bitwiseAND(MASK), run.bitwiseAND(MASK)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove the bytes covered by a LENGTH-byte string that starts earlier in the corpus.

    docs: doc_id, text (others are not read); texts count as UTF-8, null as empty. Earlier means a
    smaller doc_id, or an earlier start in the same document; a null doc_id comes before all others. Rows
    that share doc_id and text are one document and get the same result; rows that share a doc_id, or
    have none, with different texts are different documents, in order of their digests. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, and with_text kept (bytes) and spans (lo, hi of what is removed).
    """
    docs = numbered(docs)
    places = repeated_starts(docs)
    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))  # as many as a text has room for

    def cut_out(batches):
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, found in zip(batch.column(2), batch.column(3)):
                data = unsqueeze.decompress(z.as_py())
                edge = np.zeros(len(data) + 1, np.int32)
                for p in found.as_py() or ():
                    edge[p["lo"]] += 1
                    edge[p["hi"] + LENGTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), len(turn) // 2, hashlib.sha256(kept).hexdigest(), kept, [{"lo": a, "hi": b} for a, b in turn.reshape(-1, 2).tolist()]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            width = 6 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns[:width], kinds))], ["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: width + 2])

    schema = "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<lo:long,hi:long>>" * with_text
    found = docs.join(by_doc, "doc", "left").select("doc_id", "copies", "z", "places").mapInArrow(cut_out, schema)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("*", copy).drop("copies", "copy")


def op4_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))
