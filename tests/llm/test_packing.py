import zlib

import numpy as np
from llm import corpus as C
from public_tokenizers import path
from tokenizers import Tokenizer

from gridloom.llm import packing, tokens

FILE = path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(FILE)
    odd = ["Hello,  World. x.y a,b .5 e.g. Ünï. 日本語 a b \x1c ok\r\nend,", "don't it's 1,000.50 $%& a.\tb", "İstanbul ſ K", "á x", "</w> <unk> [SEP]", "ab" * 200]
    texts = C.texts() + odd + [None]
    encoder = tokens.Encoder(FILE)
    ids, lengths = encoder.encode(texts)
    ends = np.cumsum(lengths)
    for t, lo, hi in zip(texts, ends - lengths, ends):
        assert ids[lo:hi].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    encoder.forget()
    assert np.array_equal(encoder.encode(texts)[0], ids)


def test_curve_neighbours_differ_by_one_step():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    order = np.argsort(packing.hilbert_key(points, 4))
    assert sorted(packing.hilbert_key(points, 4)) == list(range(256))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_packs_every_id_once(spark):
    rows = C.rows()
    tokenizer = Tokenizer.from_file(FILE)
    out = packing.pack_along_curve(C.documents(spark), FILE, with_ids=True).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    wanted = {d: tokenizer.encode(t[0] or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    covered = {d: [] for d in wanted}
    for r in out:
        part = np.array(r["ids"], "<u4")
        assert part.tolist() == wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(wanted[r["doc_id"]]))
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    for d, at in covered.items():
        assert sorted(at) == sorted(list(range(len(wanted[d]))) * len(texts[d]))
    full = {}
    for r in out:
        full.setdefault(r["sequence_id"], []).extend(range(r["offset"], r["offset"] + r["length"]))
    assert sorted(full) == list(range(len(full)))
    assert all(sorted(v) == list(range(2048)) for k, v in full.items() if k < len(full) - 1)
    assert sorted(full[len(full) - 1]) == list(range(len(full[len(full) - 1])))


def test_empty(spark):
    assert packing.pack_along_curve(C.empty(spark), FILE).count() == 0
