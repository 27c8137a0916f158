import hashlib
import random

import numpy as np
from llm import corpus as C

from gridloom.llm import suffix


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row, rows of a doc_id being one text."""
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        data = text.encode()
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i + 1 : i + 101] = True
            seen.add(s)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~gone[1:-1]].tobytes()
        out[doc] = (doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(out[r[0]] for r in rows)


def check(spark, rows, schema="doc_id long, text string"):
    out = suffix.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out) == brute(rows)


def test_corpus(spark):
    check(spark, C.rows(), C.SCHEMA)


def repetitive(seed, n=40):
    draw = random.Random(seed)
    passages = ["".join(draw.choice("abcd \n") for _ in range(draw.randint(60, 400))) for _ in range(8)]
    out = []
    for i in range(n):
        out.append((i, "".join(draw.choice([draw.choice(passages), draw.choice(passages)[draw.randint(0, 50) :], "".join(draw.choice("xyz") for _ in range(draw.randint(0, 120)))]) for _ in range(draw.randint(0, 7)))))
    return out + [(n, "a" * 5000), (n + 1, "ab" * 2000 + "é" * 300), (n + 2, "a" * 99), (n + 3, "a" * 100), (n + 4, None)]


def test_repeats_within_and_across(spark):
    check(spark, repetitive(5))
    check(spark, repetitive(6))


def test_long_texts_and_crowded_ranks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 700)
    monkeypatch.setattr(suffix, "CROWD", 3)
    monkeypatch.setattr(suffix, "BATCH", 500)
    check(spark, repetitive(7))
    check(spark, C.rows(), C.SCHEMA)


def test_spans(spark):
    rows = repetitive(8, 10)
    for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect():
        data = (dict(rows)[r["doc_id"]] or "").encode()
        left = b"".join(data[a:b] for a, b in zip([0] + [s["hi"] for s in r["spans"]], [s["lo"] for s in r["spans"]] + [len(data)]))
        assert bytes(r["kept"]) == left and len(r["spans"]) == r["n_spans"]


def test_empty(spark):
    assert suffix.remove_repeats(C.empty(spark)).count() == 0


def brute_pairs(rows):
    """As brute, with a document for each (doc_id, text), in order of doc_id, null first, then of digest."""
    digest = lambda d, t: hashlib.sha256(f"{'' if d is None else d}:{t}".encode()).digest()
    pairs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda p: (p[0] is not None, p[0] or 0, digest(*p)))
    of = {p: r[1:] for p, r in zip(pairs, brute([(i, t) for i, (_, t) in enumerate(pairs)]))}
    return sorted(((r[0], *of[r[0], r[1] or ""]) for r in rows), key=repr)


def same_checksum(draw, head, size):
    """Two texts, the second shorter, that start with head and share 16 bits of CRC-32."""
    import zlib

    met = {}
    while True:
        text = head + "".join(draw.choice("pqrstuv") for _ in range(draw.choice(size)))
        other = met.setdefault(zlib.crc32(text.encode()) & 0xFFFF, text)
        if len(other) != len(text):
            return sorted([text, other], key=len, reverse=True)


def test_null_and_repeated_ids(spark, monkeypatch):
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh") for _ in range(240))
    tail = "".join(draw.choice("ijklm") for _ in range(300))
    long, short = same_checksum(draw, passage, (20, 300))
    rows = [(None, long), (None, short), (None, short), (-1, short), (-1, tail + passage), (7, long), (7, tail), (7, "x" + tail), (None, None), (None, "")]
    rows += [(None, passage[k : k + 150] + str(k)) for k in range(60)] + [(3, tail)] * 50
    for crowd in (suffix.CROWD, 3):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out), key=repr) == brute_pairs(rows)


def test_common_seeds_passages_and_runs(spark, monkeypatch):
    """Passages shorter and longer than 100 bytes that most texts hold, in surroundings of their own."""
    draw = random.Random(10)
    short, long = ("".join(draw.choice("abcdefghij ") for _ in range(n)) for n in (60, 130))
    word = lambda: "".join(draw.choice("klmnopqrst") for _ in range(draw.randint(5, 90)))
    rows = [(i, word() + short + word() + (long if i % 3 else "") + word() + word()) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]
    for crowd in (suffix.CROWD, 40, 1):
        monkeypatch.setattr(suffix, "CROWD", crowd)
        check(spark, rows)


def test_a_common_rank_sends_one_row_a_batch(spark):
    """However many different runs a seed has, few rows wait for their rank's others, and all of its runs are open."""
    n = 5000
    rows = spark.createDataFrame([(0, 7, u, u, u << 14) for u in range(n)] + [(0, 8, 1, n, 0)], "kind int, h long, u long, doc long, run long").repartition(16)
    kinds = [r["kind"] for r in suffix.leads(rows).collect()]
    assert kinds.count(suffix.MET) + kinds.count(suffix.LEAD) < 100
    found = suffix.rerank(rows).collect()
    assert sorted(r["doc"] for r in found if r["kind"] == suffix.OPEN) == list(range(n)) and len(found) == n
