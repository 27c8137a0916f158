"""Runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib

from llm import corpus as C

from gridloom.llm import periodic as P


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(draw):
    letters, kind = draw.choice(["ab", "abc", "abcdefghijkl"]), draw.random()
    some = lambda least, most: [draw.choice(letters) for _ in range(draw.randint(least, most))]
    if kind < 0.3:
        return some(0, 80)
    if kind < 0.6:
        period = some(1, 9)
        return some(0, 10) + period * draw.randint(1, 9) + period[: draw.randint(0, len(period))] + some(0, 10)
    if kind < 0.8:  # Fibonacci words hold as many runs as any
        x = [["a"], ["a", "b"]]
        while len(x[-1]) < draw.randint(20, 90):
            x.append(x[-1] + x[-2])
        return x[-1]
    return some(10, 10) * 3 + ["z"] + ["x"] * draw.randint(1, 40) + ["x", "y"] * draw.randint(1, 20)


def test_runs(monkeypatch):
    draw = random.Random(5)
    for turn in range(300):
        monkeypatch.setattr(P, "PAIRS", draw.choice([3, 50, 1 << 21]))
        docs = [random_words(draw) for _ in range(draw.randint(1, 12))]
        runs, collapsed = P.runs_of_texts([" ".join(d) for d in docs])
        for words, found, text in zip(docs, runs, collapsed):
            expected = brute(words)
            assert [(r["start"], r["length"], r["period"]) for r in found] == expected
            assert text == collapse(words, expected)


def test_long_repeats_take_n_log_n():
    runs, _ = P.runs_of_texts([" ".join(["a"] * 60_000 + ["b", "a"] * 30_000)])
    assert runs == [[{"start": 0, "length": 60_000, "period": 1}, {"start": 59_999, "length": 60_001, "period": 2}]]


def test_query(spark, tmp_path):
    out = {}
    for r in P.op11_suffix_tree_runs(spark, C.write(spark, tmp_path, documents=C.documents(spark, n=150))).collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    expected = {}
    for doc_id, text, *_ in C.rows(n=150):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if n < 3000 else [(r["start"], r["length"], r["period"]) for r in P.runs_of_texts([" ".join(words)])[0][0]]
        s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapse(words, runs))]
        expected.setdefault(doc_id, []).append((len(runs), s, length, q, 1000 * length // q if q else None, *digests))
    assert {k: sorted(v, key=str) for k, v in out.items()} == {k: sorted(v, key=str) for k, v in expected.items()}
    assert sum(v[0][0] > 0 for v in expected.values()) > 5
    assert P.op11_suffix_tree_runs(spark, C.write(spark, tmp_path / "none", documents=C.empty(spark))).count() == 0
