"""Ranked lexical search over a tiered index: postings of high impact first, lower tiers only where no proof is found."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, cut, drop_worker_caches, load, materialize
from .tokens import places

#: What parts terms, and the letters that are lower-cased: bytes of the UTF-8 text.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Words and documents of one chunk of the index.
CHUNK_WORDS, CHUNK_DOCS = 1 << 19, 1 << 12
#: Weight times impact that a posting has at least in each tier; the weight here is that of the term within the chunk.
TIERS = (1e9, 5e8, 0)
#: Bytes of item texts that are searched together.
BLOCK_BYTES = 1 << 24
IMPACT = 10**6


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_TABLE).split()


def size_of(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def count(batches):
        for batch in batches:
            n = [len(terms_of(t.as_py())) for t in batch.column(0) if t.is_valid]
            yield pa.RecordBatch.from_pydict({"n": [sum(x > 0 for x in n)], "l": [sum(n)]}, pa.schema([("n", pa.int64()), ("l", pa.int64())]))

    row = docs.select("text").mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _chunk(doc_ids: list, codes: list[np.ndarray], terms: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The postings of some documents, tier by tier; within a term by falling impact, then by document."""
    sizes = np.array([len(c) for c in codes], np.int64)
    key, tf = np.unique(np.concatenate(codes) << 13 | np.repeat(np.arange(len(codes)), sizes), return_counts=True)
    doc = key & 8191
    m = 75 + (25 * sizes * n_docs) // max(n_terms, 1)
    impact = (10**9 * tf) // (1000 * tf + 12 * m[doc])
    key = np.sort((key >> 13) << 34 | (IMPACT - impact) << 13 | doc)
    term, impact, doc = key >> 34, IMPACT - (key >> 13 & (1 << 21) - 1), key & 8191
    df = np.bincount(term, minlength=len(terms))
    first = np.cumsum(df) - df
    place = np.arange(len(term)) - first[term]
    row = {"doc_ids": doc_ids, "terms": terms, "df": df.astype(np.int32), "top": impact[first].astype(np.int32)}
    done = np.zeros(len(terms), np.int64)
    gain = (1000 * np.log((2 * len(codes) + 2) / (2 * df + 1)))[term] * impact
    for i, least in enumerate(TIERS):
        upto = np.bincount(term[gain >= least], minlength=len(terms))  # a term's postings fall in impact
        here = (place >= done[term]) & (place < upto[term])
        row[f"ends{i}"] = np.cumsum(upto - done).astype(np.int32)
        row[f"docs{i}"] = doc[here].astype(np.int16)
        row[f"impacts{i}"] = impact[here].astype(np.int32)
        row[f"rest{i}"] = np.where(upto < df, impact[np.minimum(first + upto, len(impact) - 1)], 0).astype(np.int32)
        done = upto
    kinds = {"doc_ids": pa.int64(), "terms": pa.binary()}
    arrays = [pa.array(v, kinds[k]) if k in kinds else pa.array(v) for k, v in row.items()]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays], list(row))


INDEX = "doc_ids array<long>, terms array<binary>, df array<int>, top array<int>, " + ", ".join(f"ends{i} array<int>, docs{i} array<short>, impacts{i} array<int>, rest{i} array<int>" for i in range(len(TIERS)))


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each chunk of neighbouring documents, in the shared folder; every document with a term is in one.

    The impact of a posting is (10^9 * tf) div (1000 * tf + 12 * m), which a term's weight multiplies. Each term of a chunk
    has its postings split into tiers by what they can add to a score, with the greatest impact that each tier leaves to the later ones. Tiers are
    columns of their own, so that a search reads no more of them than it asks for.
    """

    def build(batches):
        drop_worker_caches()
        index: dict[bytes, int] = {}
        doc_ids, codes, words = [], [], 0
        learn = lambda fresh: index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py()) if text.is_valid else []
                if not terms:
                    continue
                if doc_ids and (words + len(terms) > CHUNK_WORDS or len(doc_ids) == CHUNK_DOCS):
                    yield _chunk(doc_ids, codes, list(index), n_docs, n_terms)
                    index.clear()
                    doc_ids, codes, words = [], [], 0
                doc_ids.append(doc_id)
                codes.append(places(index, terms, learn))
                words += len(terms)
        if doc_ids:
            yield _chunk(doc_ids, codes, list(index), n_docs, n_terms)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX), **LARGE_ROWS)


def document_counts(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the terms of a block of items occurs."""
    asked = frozenset(terms)

    def count(batches):
        for batch in batches:
            for ts, df in zip(batch.column(0), batch.column(1)):
                found = [(t, n) for t, n in zip(ts.values.to_pylist(), df.values.to_numpy(zero_copy_only=False).tolist()) if t in asked]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

    return {bytes(t): n for t, n in index.select("terms", "df").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n")).collect()}


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, equal ones by id, null ids last."""
    at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    return at[np.lexsort((ids[at], null[at], -scores[at]))[:k]]


class Found:
    """Of one item the best rows so far: by what is proven of their scores, and of those whose scores are complete."""

    def __init__(self, k: int):
        self.k, self.ceiling = k, -1
        self.rows = np.empty((4, 0), np.int64)  # score, doc_id, null, complete

    def add(self, score: np.ndarray, upper: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        complete = upper == score
        if not complete.all():
            self.ceiling = max(self.ceiling, int(upper[~complete].max()))
        some = np.flatnonzero(score > 0)
        rows = np.concatenate([self.rows, np.stack([score[some], ids[some], null[some], complete[some]])], axis=1)
        keep = best(rows[0], rows[1], rows[2], self.k)
        whole = np.flatnonzero(rows[3])
        whole = whole[best(rows[0, whole], rows[1, whole], rows[2, whole], self.k)]
        self.rows = rows[:, np.union1d(keep, whole)]


FOUND = "item int, doc_id long, score long, complete boolean, ceiling long"


def search_tiers(index: DataFrame, depth: int, block: dict, floors: list[int | None], k: int) -> DataFrame:
    """What the first ``depth`` tiers tell of each item: rows (item, doc_id, score, complete, ceiling).

    A row with a document has the score that its postings in these tiers come to; it is complete if no term of the item can
    add to it. ceiling: the most that any incomplete document can reach, in rows without a document. floors: for
    each item a score that k documents reach, or None if it is answered. Chunks and documents whose bounds stay below it are
    passed over, and the deeper tiers of a chunk are met only by items that some document of it can still serve.
    """
    vocabulary, items = block["terms"], block["items"]

    def search(batches):
        found: dict[int, Found] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].values for i, name in enumerate(batch.schema.names)}
                number = {name: v.to_numpy(zero_copy_only=False) for name, v in row.items() if name not in ("terms", "doc_ids")}
                null = np.asarray(row["doc_ids"].is_null().to_numpy(zero_copy_only=False), np.int64)
                ids = row["doc_ids"].fill_null(0).to_numpy(zero_copy_only=False)
                where = np.full(len(vocabulary) + 1, -1, np.int64)
                for at, term in enumerate(row["terms"].to_pylist()):
                    t = vocabulary.get(term)
                    if t is not None:
                        where[t] = at
                for item, (terms, weight) in enumerate(items):
                    if floors[item] is None:
                        continue
                    at = where[terms]
                    here = at >= 0
                    at, w = at[here], weight[here]
                    if not len(at) or (w * number["top"][at]).sum() < floors[item]:
                        continue
                    score, alive, seen = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), []
                    for i in range(depth):
                        ends = number[f"ends{i}"]
                        end = ends[at].astype(np.int64)
                        n = end - np.where(at > 0, ends[at - 1], 0)
                        place, term = np.repeat(end - np.cumsum(n), n) + np.arange(n.sum()), np.repeat(np.arange(len(at)), n)
                        docs = number[f"docs{i}"][place]
                        if i:
                            docs, term, place = docs[hold := alive[docs]], term[hold], place[hold]
                        seen.append((docs, term))
                        np.add.at(score, docs, number[f"impacts{i}"][place] * w[term])
                        rest = w * number[f"rest{i}"][at]
                        upper = score + rest.sum()
                        for docs, term in seen:
                            np.subtract.at(upper, docs, rest[term])
                        alive &= upper >= floors[item]
                        if not alive.any():
                            break
                    else:
                        may = np.flatnonzero(alive)
                        found.setdefault(item, Found(k)).add(score[may], upper[may], ids[may], null[may])
        for item, f in found.items():
            score, ids, null, complete = f.rows
            n = len(score) + 1
            columns = [np.full(n, item, np.int32), np.append(ids, 0), np.append(score, 0), np.append(complete, 0).astype(bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], mask=np.append(null, 0).astype(bool)), pa.array(columns[2]), pa.array(columns[3]), pa.array(np.append(np.full(n - 1, -2), f.ceiling), mask=np.append(np.ones(n - 1, bool), False))],
                ["item", "doc_id", "score", "complete", "ceiling"],
            )

    columns = ["doc_ids", "terms", "top", *[f"{c}{i}" for i in range(depth) for c in ("ends", "docs", "impacts", "rest")]]
    return index.select(*columns).mapInArrow(search, FOUND)


def item_block(rows: list, n_docs: int, index: DataFrame) -> dict:
    """Terms of a block of items by number, and for each item its terms with their weights times repeats."""
    counts = [Counter(terms_of(r["text"])) if r["text"] else Counter() for r in rows]
    terms = list(dict.fromkeys(t for c in counts for t in c))
    df = document_counts(index, terms)
    number = {t: i for i, t in enumerate(t for t in terms if t in df)}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in number}
    items = []
    for c in counts:
        c = {t: n for t, n in c.items() if t in number}
        items.append((np.array([number[t] for t in c], np.int64), np.array([weight[t] * n for t, n in c.items()], np.int64)))
    return {"terms": number, "items": items}


def ranked(rows: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """rows with their place in the item's order, the first k."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def answer(index: DataFrame, rows: list, n_docs: int, k: int, told: list | None = None) -> DataFrame:
    """item, rank, doc_id, score of a block of items: tier by tier, until every item's first k are proven.

    An item is proven when k complete documents score more than the ceiling of all incomplete ones; the rest fall through
    to the next tier, in which only chunks and documents count that can still reach the k best so far. In the last tier
    all is complete.
    """
    block = item_block(rows, n_docs, index)
    floors: list[int | None] = [1 if len(terms) else None for terms, _ in block["items"]]
    answers = []
    for depth in range(1, len(TIERS) + 1):
        if told is not None:
            told.append(sum(f is not None for f in floors))
        found = materialize(search_tiers(index, depth, block, floors, k))
        docs = found.where("ceiling is null")
        kept = ranked(docs, k, "place").groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        whole = cut(ranked(docs.where("complete"), k))
        kth = whole.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        state = found.groupBy("item").agg(F.max("ceiling").alias("ceiling")).join(kept, "item", "left").join(kth, "item", "left")
        state = cut(state.select("item", "floor", F.coalesce(F.col("ceiling") < F.coalesce("kth", F.lit(0)), F.lit(False)).alias("proven")))
        answers.append(whole.join(state.where("proven"), "item", "left_semi"))
        met = {r["item"]: r for r in state.collect()}  # a row for each item of the block
        for item, floor in enumerate(floors):
            if floor is not None:
                r = met.get(item)  # an item that met nothing has no answer
                floors[item] = None if r is None or r["proven"] else max(floor, r["floor"] or 1)
        if all(f is None for f in floors):
            break
    out = answers[0]
    for a in answers[1:]:
        out = out.union(a)
    return out.select("item", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, told: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k documents of highest score above 0, equal scores by doc_id.

    docs: doc_id, text; items: item_id, text; other columns, whatever their names, are ignored. The score sums, over the
    item's terms with repeats, weight times impact (see build_index); integers throughout. Whole texts of any
    length; null and empty texts have no terms: such documents are never found, such items get no rows. Repeated documents
    rank each on its own, null ids after all others of the same score; repeated items are answered each. Empty tables give no rows.
    Items are searched in blocks of BLOCK_BYTES of text (or of one item, if it is longer), of which one at a time is on the driver. told, if given, gets
    the number of items that were searched in each tier.
    """
    spark = docs.sparkSession
    n_docs, n_terms = size_of(docs)
    items = items.select("item_id", "text")
    index = build_index(docs, n_docs, n_terms)
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = answer(index, rows, n_docs, k, told).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out


def op13_tiered_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: Over the same tables: every document scored for every item.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
docs AS (SELECT r, doc_id, ts, len(ts) AS n FROM words WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
postings AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY t, nd),
impacts AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS g FROM postings JOIN weights USING (t), total),
scores AS (SELECT item_id, r, doc_id, CAST(sum(q * g) AS BIGINT) AS score FROM impacts JOIN asked USING (t) GROUP BY ALL HAVING sum(q * g) > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scores) WHERE k <= 20
"""
