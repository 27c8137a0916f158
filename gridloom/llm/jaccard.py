"""Near-duplicate components by a size-aware heavy-light set similarity join.

A document is the set of its distinct 5-word shingles; two link when their Jaccard similarity reaches
0.8. Equal sets are one node from the start. Every set is ordered the same way, frequent shingles
last, so that two linked sets share c of the first n - ceil(0.8 n) + c shingles of each:

* light sets (up to a boundary size) list their 2-subsets of that prefix: two linked light sets meet
  in the list of a subset, and few others do;
* heavy sets list the single shingles of that prefix (c = 1), fewer keys with longer lists to scan;
* sets that are light but could link to a heavy one do both.

The boundary minimizes the keys written plus the list entries scanned, by the sizes of all sets and
the frequencies of all repeated shingles. Members of a list whose sizes and places rule out every
other member leave it. The rest are compared with a hub of the list first; connected members are
contracted, and only members in different components are compared after that, so that no link between
components is lost. A list that still holds many components is split before that: c shared shingles
of the prefix become c + 1, as linked sets also share that many, until lists are short or c is DEEPEST.
Lists that are long even then are ordered anew by the frequencies among their own members and split by that.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_worker_caches, fresh, load, materialize, rewritten
from .components import stars


#: Words of a shingle; the least similarity is NUM / DEN.
WORDS, NUM, DEN = 5, 4, 5
#: Shingles of a task that are counted together, and frequent shingles that are put last. Which ones
#: come last never changes a result, only the lengths of the lists.
COUNTED, FREQUENT = 3_000_000, 200_000
#: List entries after which a task hands them on, in one Arrow batch of some 6 MB, whatever the documents' lengths.
HELD = 1 << 18
#: Cost of comparing two sets, in keys written.
COMPARE = 50
#: Components of a list above which it is split by a further shingle, and shingles of a key until lists are ordered anew. Neither changes a result.
#: A split writes each member once for every further shingle of its prefix, so it pays for long lists only.
CROWD, DEEPEST = 2048, 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (see op3's contract)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ (total >> np.uint64(31))) * MULTIPLIER + h[i : n - width + 1 + i]
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


def at_least(n: int) -> int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-NUM * n // DEN)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    low, high = sorted((len(a), len(b)))
    if not low or DEN * low < NUM * high:
        return False
    joined = np.concatenate([a, b])
    joined.sort(kind="stable")
    both = int((joined[1:] == joined[:-1]).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def describe(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of two kinds. Of each document (kind 0): doc_id, t (a hash of its text), n, a and b, two hashes of its set.
    Of each shingle repeated among documents read together (kind 1): a, the shingle, and n, how often."""

    def run(batches):
        drop_worker_caches()
        ahead, held = [], 0

        def counts():
            every = np.concatenate(ahead)
            ahead.clear()
            every.sort()
            values, n = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
            n += 1
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), none, none, pa.array(n, pa.int64()), pa.array(values.view(np.int64)), none], NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    s = shingle_hashes(text)
                    out.append((len(s), *digest(s, seed)))
                    ahead.append(s)
                    held += len(s)
                n, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], NAMES)
                if held > COUNTED:
                    yield counts()
                    held = 0
        if ahead:
            yield counts()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, "kind int, doc_id long, t long, n long, a long, b long")


NAMES = ["kind", "doc_id", "t", "n", "a", "b"]


def most_frequent(counted: DataFrame) -> tuple[np.ndarray, int]:
    """(shingles that repeat most, sorted; sum of the squares of the other counts).

    A histogram of the counts, of a bounded number of levels, gives the count from which at most FREQUENT
    shingles stand; those alone reach the driver.
    """
    level = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.lit(1024) + F.floor(F.log2(F.col("n") / 1024) * 64))
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum(F.col("n") * F.col("n")).alias("squares")).collect()
    total, least, rest = 0, None, sum(r["squares"] for r in levels)
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["k"]
        if total > FREQUENT:
            break
        least, rest = r["least"], rest - r["squares"]
    top = counted.where(F.col("n") >= least).select("a").collect() if least is not None else []
    return np.sort(np.array([r["a"] for r in top], np.int64).view(np.uint64)), rest


def boundary(sizes: list[tuple[int, int]], scanned: float) -> int:
    """Largest size of a light set: the least sum of subsets written and list entries scanned.

    sizes: (size, sets of that size). scanned: mean entries that a list entry is compared with.
    """
    sizes = sorted(sizes)
    subsets, lists = [], []
    for n, count in sizes:
        p = n - at_least(n)
        subsets.append(count * min(n, p + 2) * (min(n, p + 2) - 1) / 2)
        lists.append(count * (p + 1) * (1 + scanned))
    best, light, heavy, j = (sum(lists), 0), 0.0, sum(lists), 0
    for (n, _), s in zip(sizes, subsets):
        light += s
        while j < len(sizes) and DEN * sizes[j][0] <= NUM * n:
            heavy -= lists[j]
            j += 1
        best = min(best, (light + heavy, n))
    return best[1]


def in_order(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set's shingles in the order of all prefixes: frequent ones last."""
    if not len(often):
        return s
    found = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
    return np.concatenate([s[~found], s[found]])


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The key of a key and a further shingle."""
    return (x ^ (y >> np.uint64(17)) ^ (y << np.uint64(47))) * MULTIPLIER + y


#: key, node, n, at: the list, a member (the first hash of its set), its size, and where its key ends in its order: at is 16
#: times the shingles before the key's last that are not of the key, plus the shingles of the key.
ENTRY, FIELDS, PLACE = "key long, node long, n int, at int", ["key", "node", "n", "at"], 16


def list_entries(docs: DataFrame, frequent, light: int, seed: int) -> DataFrame:
    """The lists (ENTRY) in which each set stands. frequent: a broadcast array."""

    def run(batches):
        often, held = frequent.value, 0
        keys, nodes, sizes, places = [], [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    if held > HELD:
                        yield entries(keys, nodes, sizes, places)
                        keys, nodes, sizes, places, held = [], [], [], [], 0
                    s = shingle_hashes(text)
                    n = len(s)
                    if n < 2:
                        continue  # links to equal sets only
                    order, node, p = in_order(s, often), digest(s, seed)[0], n - at_least(n)
                    if n <= light:
                        i, j = np.triu_indices(min(n, p + 2), 1)
                        k = joined(order[i], order[j])
                        keys.append(k)
                        places.append(((j - 1) * PLACE + 2).astype(np.int32))
                        nodes.append(np.full(len(k), node, np.int64))
                        sizes.append(np.full(len(k), n, np.int32))
                        held += len(k)
                    if DEN * n > NUM * light:
                        keys.append(order[: p + 1])
                        places.append(np.arange(p + 1) * PLACE + 1)
                        nodes.append(np.full(p + 1, node, np.int64))
                        sizes.append(np.full(p + 1, n, np.int32))
                        held += p + 1
        if keys:
            yield entries(keys, nodes, sizes, places)

    return docs.select("text").mapInArrow(run, ENTRY)


def entries(keys, nodes, sizes, places) -> pa.RecordBatch:
    columns = (np.concatenate(x) for x in (keys, nodes, sizes, places))
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t) if x.dtype != np.uint64 else x.view(t)) for x, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))], FIELDS)


def shared_lists(entries: DataFrame) -> DataFrame:
    """The entries of keys that two sets or more have, each once.

    Entries stream by in order of key and node; only the last one is held back.
    """

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held[0], rows)]
            key, node = rows[0], rows[1]
            if not len(key):
                continue
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            rows = [r[first] for r in rows]
            key = rows[0]
            same = key[1:] == key[:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if held is not None:
                shared[0] |= held[1]
            held = [r[-1:].copy() for r in rows], bool(shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][shared[:-1]]) for r in rows], FIELDS)
        if held is not None and held[1]:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in held[0]], FIELDS)

    sorted_ = entries.repartition("key").sortWithinPartitions("key", "node")
    return sorted_.mapInArrow(run, ENTRY)


def may_link(x: str, y: str) -> F.Column:
    """Whether sizes, and what follows their first shared key, leave room for the similarity."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    place = lambda z: F.floor(F.col(f"{z}.at") / PLACE)
    room = F.least(nx - place(x), ny - place(y))
    return (DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)) & ((NUM + DEN) * room >= NUM * (nx + ny))


def with_partners(lists: DataFrame) -> DataFrame:
    """The entries that may link to another member of their list.

    Members of equal size and place are one row here, so a list of any length is as many rows as it
    has sizes and places.
    """
    kinds = lists.groupBy("key", "n", "at").agg((F.count("*") > 1).alias("several"))
    x, y = kinds.alias("x"), kinds.alias("y")
    other = (F.col("x.n") != F.col("y.n")) | (F.col("x.at") != F.col("y.at")) | F.col("x.several")
    able = cut(x.join(y, (F.col("x.key") == F.col("y.key")) & other & may_link("x", "y"), "left_semi").select("key", "n", "at"))  # so that the join splits
    return lists.join(able.hint("merge"), ["key", "n", "at"], "left_semi").select(FIELDS)


def sets_of(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """node, shingles (see pack) of the given nodes, one row per node."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = {}
                for text in batch.column(0).slice(at, 256).to_pylist():
                    s = shingle_hashes(text)
                    out[digest(s, seed)[0]] = pack(s)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary").join(nodes, "node").dropDuplicates(["node"])


def pack(s: np.ndarray) -> bytes:
    """All 64 bits of sorted hashes: first bytes (long runs), then second bytes, and so on."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity. b may repeat often, a should not."""
    one = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    two = one.join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            hit = [linked(unpack(p.as_py()), unpack(q.as_py())) for p, q in zip(x, y)]
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each member of a list with the member that stands in most lists.

    The hub is found by partial maxima; a long list meets it in a join of one row a list, which splits.
    """
    lists = lists.join(lists.groupBy("node").agg(F.count("*").alias("stands")), "node")
    hubs = cut(lists.groupBy("key").agg(F.max(F.struct("stands", "node", "n", "at")).alias("y")))  # so that the join splits
    rows = lists.select("key", F.struct("node", "n", "at").alias("x")).join(hubs.hint("merge"), "key")
    return rows.where((F.col("x.node") != F.col("y.node")) & may_link("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def deeper(lists: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """The lists split: every member goes to the lists of its key and one further shingle of its prefix.

    Two linked sets share c + 1 shingles of their prefixes of n - ceil(0.8 n) + c + 1, so they meet again.
    """

    def run(batches):
        often = frequent.value
        for batch in batches:
            keys, nodes, sizes, places = [], [], [], []
            for key, node, n, at, blob in zip(*(c.to_pylist() for c in batch.columns)):
                count = at % PLACE
                last = at // PLACE + count - 1
                end = min(n, n - at_least(n) + count + 1)
                order = in_order(unpack(blob), often)[last + 1 : end]
                with np.errstate(over="ignore"):
                    keys.append(joined(np.array([key], np.int64).view(np.uint64), order))
                nodes.append(np.full(len(order), node, np.int64))
                sizes.append(np.full(len(order), n, np.int32))
                places.append((np.arange(last + 1, end) - count) * PLACE + count + 1)
            if keys:
                yield entries(keys, nodes, sizes, places)

    rows = lists.select(FIELDS).join(sets, "node").select(*FIELDS, "shingles").mapInArrow(run, ENTRY)
    return with_partners(materialize(shared_lists(rows)))


def reordered(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The lists split by their members' own frequencies: within a list the shingles that most members have come last, and each
    member goes to the lists of its key and one shingle of its prefix in that order.

    Any order that all members of a list follow will do, so two linked sets meet again. What members share beyond their key
    leaves the prefixes unless it makes up four fifths of a set: a passage common to a list, however rare elsewhere, lists nothing.
    """

    def run(batches):
        names = ["key", "node", "n", "shingle"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [unpack(blob) for blob in part.column(3).to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(s) for s in found])
                columns = [pa.array(part.column(i).to_numpy()[row]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found).view(np.int64))], names)

    rows = lists.select("key", "node", "n").join(sets, "node").select("key", "node", "n", "shingles")
    rows = materialize(rows.mapInArrow(run, "key long, node long, n int, shingle long"))
    counts = cut(rows.groupBy("key", "shingle").agg(F.count("*").alias("members")))  # so that the join splits
    place = F.row_number().over(Window.partitionBy("key", "node").orderBy("members", "shingle"))  # as many rows as a set has shingles
    rows = rows.join(counts.hint("merge"), ["key", "shingle"]).withColumn("place", place)
    rows = rows.where((F.col("place") <= F.col("n") - F.ceil(NUM * F.col("n") / DEN) + 1) & (F.col("members") > 1))
    rows = rows.select(F.xxhash64("key", "shingle").alias("key"), "node", "n", ((F.col("place") - 1) * PLACE + 1).cast("int").alias("at"))
    return with_partners(materialize(shared_lists(rows)))


def crossing_pairs(lists: DataFrame, components: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """(a, b): pairs of list members in different components.

    The component with most members of a list is its main one; only the others, the strays, are
    paired, with all members of other components. Lists of more than CROWD components are split first: by a further
    shingle up to DEEPEST, then by their own frequencies, as long as that takes a tenth off the pairs that they would make.
    """
    out, before = None, None
    for depth in count(1):
        known = lists.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = known.groupBy("key", "component").agg(F.count("*").alias("members"))
        main = parts.groupBy("key").agg(F.max(F.struct("members", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
        main = cut(main.select("key", "parts", F.col("m.component").alias("main")))  # so that the join splits
        known = materialize(known.join(main.hint("merge"), "key"))
        pairs = main.where(F.col("parts") > CROWD).agg(F.sum(F.col("parts").cast("double") ** 2)).first()[0] or 0.0
        last = not pairs or (depth > DEEPEST and pairs > 0.9 * before)
        before = pairs
        crowded = F.lit(False) if last else F.col("parts") > CROWD
        short = known.where(~crowded)
        x, y = short.where("component <> main").alias("x"), short.alias("y")
        rows = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & may_link("x", "y"))
        rows = rows.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        out = rows if out is None else out.union(rows)
        if last:
            return out.distinct()
        lists = known.where(crowded)
        lists = deeper(lists, sets, frequent) if depth < DEEPEST else reordered(lists, sets)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parts). rows: doc_id, t, n, a of every row of ``docs``: t is xxhash64 of the text, n the size of its set and a the
    first hash of it. parts: node, root, part of every set that is not empty: its hash, the smallest doc_id that has it, and the number of its component."""
    for seed in range(8):
        described = materialize(describe(docs, seed))
        rows = described.where("kind = 0")
        classes = cut(rows.where("n > 0").groupBy("a").agg(F.min("doc_id").alias("root"), F.max("n").alias("n"), F.min("b").alias("low"), F.max("b").alias("high")))
        if classes.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("sets of different documents kept colliding")
    often, rest = most_frequent(described.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 64)  # a bounded number of levels of size
    sizes = [(int(r["size"]), r["k"]) for r in classes.groupBy(level).agg(F.max("n").alias("size"), F.count("*").alias("k")).collect()]
    light = boundary(sizes, COMPARE * rest / max(1, sum(n * c for n, c in sizes)))
    frequent = docs.sparkSession.sparkContext.broadcast(often)  # FREQUENT numbers at most
    lists = rewritten(shared_lists(list_entries(docs, frequent, light, seed)), with_partners)
    sets = materialize(sets_of(docs, lists.select("node").distinct(), seed))
    tried = cut(hub_pairs(lists))
    links = cut(verified(tried, sets))
    known = stars(links)
    more = crossing_pairs(lists, known, sets, frequent)
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(ordered(more).join(ordered(tried), ["a", "b"], "left_anti").distinct())
    found = cut(verified(more, sets))
    if not found.isEmpty():
        known = stars(known.toDF("a", "b").union(found))  # a star reaches what its links reach
    parts = classes.select("a", "root").join(known, F.col("a") == F.col("node"), "left")
    parts = cut(parts.select(F.col("a").alias("node"), "root", F.coalesce("component", "a").alias("part")))  # so that its joins split
    return rows.select("doc_id", "t", "n", "a"), parts


def with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows with what ``parts`` has of their sets; nulls for empty sets."""
    return rows.join(parts, (F.col("n") > 0) & (F.col("a") == F.col("node")), "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; others are not read).

    component_id is the smallest doc_id that links reach; ties do not arise. A text that is null or has no word is an
    empty set, linked with nothing. Whole texts count, however long. Rows of equal sets, copies of a row among them,
    share a component whatever their number; a doc_id that repeats with other texts counts as so many documents. An
    empty table gives an empty result.
    """
    rows, parts = grouped(docs)
    least = cut(parts.groupBy("part").agg(F.min("root").alias("component_id")))  # so that the join splits
    parts = parts.join(least.hint("merge"), "part").select("node", "component_id")
    return with_parts(rows, parts).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns stay, whatever their names.

    Of rows that share doc_id and text one stays; of those of a component that share its smallest
    doc_id with different texts the one of the least text hash. Documents without words are in no
    group and stay. An empty table gives an empty result.
    """
    doc_id, t = fresh("kept_id", docs), fresh("kept_text", docs)
    rows = materialize(with_parts(*grouped(docs.select("doc_id", "text"))).select("doc_id", "t", "part"))  # read twice
    heads = rows.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "t")).alias("m")).select("m.doc_id", "m.t")
    keep = heads.union(rows.where("part is null").select("doc_id", "t")).distinct().withColumnsRenamed({"doc_id": doc_id, "t": t})
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.xxhash64("text").eqNullSafe(F.col(t))
    return docs.join(keep.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "text"])


def op3_heavy_light_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
