"""A small corpus with the cases that operators must bear."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, h long, `key` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("ba", "ko", "ri", "ten", "mu", "sal", "Ved", "lo") for b in ("na", "mit", "ra", "po", "zel", "ü", "quis", "ters")]


def sentence(draw, n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n)) + "."


def prose(draw, n):
    return "\n".join(sentence(draw, draw.randint(6, 14)) for _ in range(n))


def texts(seed=1, n=60):
    draw = random.Random(seed)
    out = [prose(draw, draw.randint(2, 14)) for _ in range(n)]
    for k in range(0, 20, 2):  # near copies: a few words differ
        words = out[k].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [out[3]] * 25  # exact copies
    passage = prose(draw, 6)
    out += [sentence(draw, 8) + passage + sentence(draw, 8) for _ in range(6)]
    out += ["", " ", "\n\t\n", "one", "One two three four", "one two THREE four", "a b c d e", "x " * 300, "no break é ☃ 𝄞 end.", "same line.\nsame line.\nsame line."]
    out.append(prose(draw, 900))  # very long
    return out


def rows(seed=1, n=60):
    """Documents with nulls in every column, a repeated row, and columns whose names clash."""
    draw = random.Random(seed + 1)
    found = [(i, t, ("en", "de", "fr")[i % 3], ("hot", "b", "c", "hot")[i % 4], len(t), i, f"s{i}", -i, "k") for i, t in enumerate(texts(seed, n))]
    k = len(found)
    found += [(k, None, "en", "hot", None, None, None, None, None), (k + 1, None, None, None, None, 1, "x", 2, None), (k + 2, found[0][1], None, None, 3, None, None, None, None)]
    found.append(found[5])
    draw.shuffle(found)
    return found


def documents(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
