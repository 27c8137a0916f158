import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llm import corpus as C

from gridloom.llm import jaccard
from gridloom.llm.components import are_stars, connected_components, stars

#: Of keep_one on the small corpus: 75, and 129 when components were searched twice and met in one large plan.
JOBS = 95
LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def shingles(text):
    words = C.WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def variants(seed, n=30, size=60):
    """Chains of texts, each with a few words of the one before it changed."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = [draw.choice(C.VOCABULARY) + str(draw.randint(0, 99)) for _ in range(draw.randint(1, size))]
        for _ in range(draw.randint(1, 6)):
            out.append(" ".join(words))
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = draw.choice(C.VOCABULARY)
            words = words[: draw.randint(max(1, len(words) - 3), len(words))]
    return [(i, t) for i, t in enumerate(out)]


def check(spark, rows, schema):
    out = jaccard.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute(rows)


def test_corpus(spark):
    check(spark, C.rows(), C.SCHEMA)


def test_variants(spark):
    check(spark, variants(3), "doc_id long, text string")


def test_boundary_either_way(spark, monkeypatch):
    for light in (0, 20, 10**6):
        monkeypatch.setattr(jaccard, "boundary", lambda *_, light=light: light)
        check(spark, variants(light, 15), "doc_id long, text string")


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    check(spark, variants(9, 15), "doc_id long, text string")


def test_crowded_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    for light in (0, 10**6):
        monkeypatch.setattr(jaccard, "boundary", lambda *_, light=light: light)
        check(spark, variants(21 + light, 12), "doc_id long, text string")


def test_lists_that_stay_long_are_ordered_anew(spark, monkeypatch):
    """A template of two fifths of every text, in no list of frequent shingles: the pairs compared stay few, and no link is lost."""
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "DEEPEST", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    written = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: written.append(pairs.count()) or verified(pairs, sets))
    draw = random.Random(8)
    template = " ".join(f"form{i}" for i in range(30))
    rows = [(i, f"{template} {' '.join(f'own{i}x{j}' for j in range(36 + i % 5))}") for i in range(120)]
    rows += [(200 + i, t.replace(f"own{i}x20", "changed")) for i, t in draw.sample(rows, 12)]
    for light in (0, 10**6):
        written.clear()
        monkeypatch.setattr(jaccard, "boundary", lambda *_, light=light: light)
        check(spark, rows, "doc_id long, text string")
        assert written[1] < 300, written  # 7,000 pairs share the template


def test_a_passage_that_all_documents_share(spark):
    """10,000 documents share one passage and nothing else: they must not be compared in pairs."""
    draw = random.Random(5)
    passage = " ".join(draw.choice(C.VOCABULARY) + str(i) for i in range(20))
    rows = [(i, f"{passage} {' '.join(f'own{i}x{j}' for j in range(3 + i % 3))}") for i in range(10_000)]
    rows += [(10_000 + i, rows[i][1] + " more") for i in range(0, 50)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(out[i] == i for i in range(10_000)) and all(out[10_000 + i] in (i, 10_000 + i) for i in range(50))
    small = [r for r in rows if r[0] < 120 or r[0] >= 10_000]
    assert {d: c for d, _, c in brute(small)} == {d: c for d, c in out.items() if d < 120 or d >= 10_000}


def test_all_bits_of_a_shingle_count():
    s = jaccard.shingle_hashes(" ".join(f"w{i}" for i in range(500)))
    assert jaccard.unpack(jaccard.pack(s)).tolist() == s.tolist() and jaccard.unpack(jaccard.pack(s[:0])).tolist() == []
    assert not jaccard.linked(s, jaccard.unpack(jaccard.pack(s)) ^ jaccard.np.uint64(1))


def test_keep_one_of_repeated_ids_and_clashing_names(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words), (1, words + " more"), (2, words), (3, "alone"), (3, words + " more"), (None, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept_id", "2 AS kept_text", "3 AS part", "4 AS t", "5 AS n")
    kept = jaccard.keep_one(df)
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert kept.columns == df.columns and found in ([(0, ""), (0, "x"), (1, words), (3, "alone")], [(0, ""), (0, "x"), (1, words + " more"), (3, "alone")])


def test_empty(spark):
    assert jaccard.near_duplicates(C.empty(spark)).count() == 0
    assert jaccard.keep_one(C.empty(spark)).count() == 0


def test_keep_one(spark):
    rows = C.rows()
    kept = jaccard.keep_one(C.documents(spark))
    assert kept.columns == C.documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, _, c in brute(rows) if d == c})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), min_size=0, max_size=30), st.lists(st.sampled_from("abcdefg"), min_size=0, max_size=30))
def test_linked(x, y):
    a, b = shingles(" ".join(x)), shingles(" ".join(y))
    want = bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    assert jaccard.linked(jaccard.shingle_hashes(" ".join(x)), jaccard.shingle_hashes(" ".join(y))) == want


def test_boundary_is_the_cheapest_size():
    sizes = [(5, 100), (40, 50), (400, 20), (5000, 1)]
    assert jaccard.boundary(sizes, 0) <= jaccard.boundary(sizes, 10) <= jaccard.boundary(sizes, 10**7)


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(draw.randint(300, 400), draw.randint(300, 400)) for _ in range(40)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges * 250:
        low = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = low
    assert all(found[n] == c for n, c in root.items())


def test_stars(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert are_stars(edges([])) and are_stars(edges([(5, 1), (6, 1), (9, 2)]))
    assert not are_stars(edges([(5, 1), (5, 2)])) and not are_stars(edges([(5, 3), (3, 1)]))
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 101), (7, 7)]
    assert {tuple(r) for r in stars(edges(path)).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def jobs_of(spark, name, work):
    """Jobs that ``work`` runs: one for each exchange, among others."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)


def test_few_jobs(spark):
    """The driver keeps a thread for each exchange of the last minute, so their number bounds its memory."""
    docs = spark.createDataFrame(C.rows(), C.SCHEMA)
    n = jobs_of(spark, "keep_one", lambda: jaccard.keep_one(docs).write.format("noop").mode("overwrite").save())
    assert n <= JOBS, n
