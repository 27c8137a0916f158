from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import corpus as C
from pyspark.sql import functions as F

from gridloom.llm import mixing


def brute_targets(sizes, weights):
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        live = [i for i in range(len(sizes)) if i not in capped and sizes[i]]
        share = {i: left * weights[i] / sum(weights[j] for j in live) for i in live}
        over = {i for i in live if share[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in capped else share.get(i, 0.0) for i in range(len(sizes))]
        capped |= over


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    assert np.allclose(mixing.targets(sizes, weights), brute_targets(sizes, weights))


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000, 4096, 5001):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9))) == list(range(n))


def test_mix(spark):
    rows = C.rows(n=400)
    documents, pieces = mixing.mix(C.documents(spark, n=400))
    out = documents.collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(C.WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    want = dict(zip(order, brute_targets([size[s] for s in order], [1, 2, 3, 1])))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(C.WORD.findall(r[1] or ""))) for r in rows)
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK + 0.02 * want[s]
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(C.documents(spark, n=400).repartition(3))[0].collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in out}
    assert pieces.where("lo >= hi or lo < 0").count() == 0


def brute_taken(rows, seed=8):
    """What each (doc_id, size) gives, with the same draws and permutations but blocks laid out and counted word by word."""
    sizes = {}
    for _, source, n, *_ in rows:
        sizes[source] = sizes.get(source, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s))
    goal = brute_targets([sizes[s] for s in order], [1, 2, 3, 1])
    blocks = np.array([-(-sizes[s] // mixing.BLOCK) for s in order])
    want = np.array([g * b / sizes[s] if sizes[s] else 0 for s, g, b in zip(order, goal, blocks)])
    total = mixing.draw_counts(want, 3 * blocks, seed).sum(0)
    taken = Counter()
    for k, s in enumerate(order):
        words = [r for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[4], r[3], r[0] is not None, r[0], r[2])) for _ in range(r[2])]
        for j in range(total[k]):
            b = int(mixing.permute(np.array([j % blocks[k]]), blocks[k : k + 1], np.array([k + 1 + seed]))[0])
            for r in words[b * mixing.BLOCK : (b + 1) * mixing.BLOCK]:
                taken[r[0], r[2]] += 1
    return taken


def test_blocks_against_brute_force(spark):
    docs = C.documents(spark, n=150).dropDuplicates(["doc_id"])
    n, seed = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"), 8
    rows = docs.select("doc_id", "source", n.alias("n")).select("doc_id", "source", "n", F.xxhash64("doc_id", F.lit(seed)), F.pmod(F.xxhash64("doc_id", "n", F.lit(seed + 1)), F.lit(mixing.BUCKETS)))
    want = brute_taken([tuple(r) for r in rows.collect()])
    got = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(docs)[0].collect()}
    assert got == {k: want[k] for k in got} and +want == Counter({k: v for k, v in got.items() if v})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=8), st.integers(0, 99))
def test_draws_fill_every_slot(blocks, seed):
    blocks = np.array(blocks)
    want = np.array(mixing.targets(blocks.tolist(), [1 + i % 3 for i in range(len(blocks))]))
    counts = mixing.draw_counts(want, 3 * blocks, seed)
    assert counts.sum() == min(round(want.sum()), 3 * blocks.sum()) and (counts.sum(0) <= 3 * blocks).all() and (counts >= 0).all()


def test_draws_are_multinomial():
    want = np.array([3000.0, 5000.0, 2000.0])
    first = np.array([mixing.draw_counts(want, np.array([9000, 9000, 9000]), s)[0] for s in range(400)])
    n = first[0].sum()
    assert np.allclose(first.mean(0), n * want / want.sum(), atol=1.5) and np.allclose(first.var(0), n * (want / 10000) * (1 - want / 10000), rtol=0.3)
    assert abs(mixing.draw_counts(want, np.array([9000, 9000, 9000]), 1).sum(0) - want).max() < 60


def test_clashing_names(spark):
    docs = C.documents(spark).withColumns({"uid": F.lit("u"), "pass": F.lit("p"), "k": F.lit(1), "taken pieces": F.lit(None).cast("string"), "lo": F.lit(2)})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {(r["uid"], r["pass"], r["k"], r["lo"]) for r in out.collect()} == {("u", "p", 1, 2)}


def test_texts(spark):
    docs = C.documents(spark)
    taken = Counter()
    for r in mixing.mix(docs)[0].collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r[0]: Counter(C.WORD.findall(r[1] or "")) for r in C.rows()}
    found = Counter()
    for r in mixed.collect():
        assert not Counter(C.WORD.findall(r["text"])) - words[r["doc_id"]] and r["n_chars"] == len(r["text"])
        found[r["doc_id"]] += len(C.WORD.findall(r["text"]))
    assert +found == +taken


def test_empty(spark):
    documents, pieces = mixing.mix(C.empty(spark))
    assert documents.count() == pieces.count() == mixing.mixed_documents(C.empty(spark)).count() == 0
