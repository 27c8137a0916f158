"""Secret scans with built-in functions only.

Fixed patterns find assignments, access keys and hex strings. Besides, maximal runs of key characters
are candidates: a window slides over a candidate, its character counts change by one in and one out,
and the windows whose Shannon entropy reaches the threshold of the candidate's character class make a
span, unless an allow-list pattern knows the candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, load

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs of at least so many characters; the same matches as the open runs, less those too short.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters of the sliding window, and bits a character that a window must reach by the characters of its candidate:
#: hexadecimal, one case with digits, both cases with digits, and anything with signs.
WINDOW = 20
CLASSES = [("^[0-9a-fA-F]+$", 2.85), ("^[a-z0-9]+=*$|^[A-Z0-9]+=*$", 3.45), ("^[a-z0-9_-]+=*$|^[A-Z0-9_-]+=*$", 3.55), ("^[A-Za-z0-9]+=*$", 3.65), ("", 3.8)]
#: Candidates that no scan should report: letters or digits alone, words and short numbers joined by signs, UUIDs,
#: samples and counting runs. Loops are possessive: they neither recurse nor give back.
ALLOWED = (
    r"^[0-9=+/_-]++$|^[A-Za-z=+/_-]++$"
    r"|^[_/+-]{0,2}+(?:[A-Z]?+[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[_/+-]{1,2}+(?:[A-Z]?+[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[0-9]{0,4}+[_/+-]?+=*+$"
    r"|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|(?i:(?:^|[_/+-])(?:example|sample|dummy|placeholder|changeme)|example=*$|xxxxxxxx|0123456789|1234567890|abcdefghij)"
)
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:bigint,rank:int,end:bigint,word:string>"
#: n log2 n in billionths of a bit: sums of whole numbers are the same in any order.
WEIGHTS = [round(n * math.log2(n) * 1e9) if n else 0 for n in range(WINDOW + 2)]
#: Characters of a stretch of a long candidate or text, and spans that are added up at once.
STRETCH, BLOCK = 4096, 256


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: within a lambda a column would be computed at every step."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, kind: str, start: Column, step) -> Column:
    """The results of step(state, item) -> (state, result) along an array; kind is the type of a result.

    Results grow within blocks, and the blocks are joined at the end, as every concat copies what it extends.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    nones = F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc, item):
        state, result = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def block(xs):
        def many(acc, at):
            part = F.aggregate(F.slice(xs, at + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(BLOCK)), F.struct(start.alias("state"), nones.alias("out")), many, lambda acc: F.flatten(acc["out"]))

    return let(items, block)


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of all matches, by code points: what stands between matches gives their places.

    Texts without a match, most of them, are only searched once.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = let(found, lambda ws: F.zip_with(ws, F.slice(between, 1, F.size(ws)), lambda w, b: F.struct(w.alias("word"), b.alias("between"))))

    def step(at, pair):
        start = at + F.length(pair["between"])
        end = start + F.length(pair["word"])
        return end, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), pair["word"].alias("word"))

    return F.when(text.rlike(pattern), running(pairs, SPAN, F.lit(0).cast("long"), step)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def hits_of(stretch: Column, least: Column) -> Column:
    """(lo, hi): from the first to the last window of a stretch whose entropy reaches ``least``; null without one.

    counts holds how often each ASCII character stands in the window, as the character 48 further on;
    total is the sum of n log2 n over them, so that the entropy is log2(WINDOW) - total / WINDOW. Each
    step adds a character and drops the oldest: two counts change, whatever the length.
    """
    chars = F.split(stretch, "")
    pairs = let(chars, lambda cs: F.zip_with(cs, F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), WINDOW), cs), F.lit(1), F.size(cs)), lambda new, old: F.struct(new.alias("new"), old.alias("old"))))
    gains = F.array(*[F.lit(b - a) for a, b in zip(WEIGHTS, WEIGHTS[1:])])  # of one more, from each count
    most = F.lit(float(WINDOW * 1e9)) * (F.lit(math.log2(WINDOW)) - least)
    count = lambda acc, c: F.ascii(F.substr(acc["counts"], F.ascii(c) + 1, F.lit(1))) - 48
    put = lambda counts, c, n: F.overlay(counts, F.chr(n + 48), F.ascii(c) + 1, F.lit(1))

    def step(acc, pair):
        new, old = pair["new"], pair["old"]
        gain = F.element_at(gains, count(acc, new) + 1)
        grown = put(acc["counts"], new, count(acc, new) + 1)
        total = F.when(old.isNull(), acc["total"] + gain).when(new == old, acc["total"]).otherwise(acc["total"] + gain - F.element_at(gains, count(acc, old)))
        counts = F.when(old.isNull(), grown).when(new == old, acc["counts"]).otherwise(put(grown, old, count(acc, old) - 1))
        return F.struct((acc["at"] + 1).alias("at"), counts.alias("counts"), total.alias("total"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))

    def mark(acc):
        hit = (acc["at"] >= WINDOW) & (acc["total"] <= most)
        lo = F.when(hit & acc["lo"].isNull(), acc["at"] - WINDOW).otherwise(acc["lo"])
        return F.struct(acc["at"].alias("at"), acc["counts"].alias("counts"), acc["total"].alias("total"), lo.alias("lo"), F.when(hit, acc["at"]).otherwise(acc["hi"]).alias("hi"))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit("0" * 128).alias("counts"), F.lit(0).cast("long").alias("total"), none.alias("lo"), none.alias("hi"))
    return F.aggregate(pairs, start, lambda acc, pair: let(step(acc, pair), mark), lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def stretches(text: Column, after: int = 0) -> Column:
    """A text cut every STRETCH code points, each stretch with up to ``after`` code points of the next."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    if not after:
        return cut
    ahead = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}(?=(.{{0,{after}}}))"), F.lit(1))
    return F.zip_with(cut, ahead, lambda c, a: F.concat(c, a))


def entropy_span(span: Column) -> Column:
    """The part of a candidate from its first to its last window of high entropy, or null.

    Stretches of a long candidate are scanned one by one, each with the start of the next, so that
    time grows in proportion to the length and memory with one stretch.
    """
    word = span["word"]
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(word.rlike(pattern), F.lit(bits)).otherwise(least)
    parts = let(least, lambda bar: F.transform(stretches(word, WINDOW - 1), lambda s, i: let(hits_of(s, bar), lambda h: F.struct((h["lo"] + i * STRETCH).alias("lo"), (h["hi"] + i * STRETCH).alias("hi")))))
    whole = let(parts, lambda ps: F.struct(F.array_min(F.transform(ps, lambda p: p["lo"])).alias("lo"), F.array_max(F.transform(ps, lambda p: p["hi"])).alias("hi")))
    found = let(whole, lambda p: F.struct((span["start"] + p["lo"]).alias("start"), F.lit(3).alias("rank"), (span["start"] + p["hi"]).alias("end"), word.alias("word")))
    return F.when(~word.rlike(ALLOWED), found)


def with_spans(docs: DataFrame, base: str, spans: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= ASSIGN_LEAST
    fixed = F.concat(F.filter(matches(text, ASSIGN, 0), long_enough), matches(text, ACCESS, 1), matches(text, HEX, 2))
    high = F.filter(F.transform(matches(text, CANDIDATE, 3), entropy_span), lambda s: s["start"].isNotNull())
    return docs.withColumn(base, F.array_sort(fixed)).withColumn(spans, F.array_sort(F.concat(base, high)))


def scan(docs: DataFrame) -> DataFrame:
    """Add ``secret_base`` and ``secret_spans`` to ``docs`` (which has a column text).

    Both are arrays of (start, rank, end, word): places in code points, the end exclusive; rank counts
    within KINDS; sorted by start, then rank. secret_base has the fixed patterns' spans, and
    secret_spans those and the entropy spans. A null text is empty and has none. Texts and candidates
    of any length are scanned whole, in time that grows in proportion to them. Equal rows get equal
    spans; an empty table gives an empty result. Earlier columns of these two names are replaced, all
    others stay. No shuffle.
    """
    return with_spans(docs, "secret_base", "secret_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark``; overlapping spans become one, n_chars is made to fit if present.

    All columns and rows of docs stay, whatever the columns' names, and null texts stay null. Long texts with
    many secrets are put together from stretches, so that no piece is searched for from the text's start.
    """
    base, spans = fresh("base", docs), fresh("spans", docs)
    scanned = with_spans(docs, base, spans)

    def fuse(at, s):  # kept text lies between the greatest end so far and the next start
        piece = F.struct(at.alias("lo"), s["start"].alias("hi"), (s["start"] >= at).alias("fresh"))
        return F.greatest(at, s["end"]), piece

    last = F.struct(F.length("text").cast("long").alias("start"), F.lit(9).alias("rank"), F.length("text").cast("long").alias("end"), F.lit("").alias("word"))
    kept = F.filter(running(F.concat(spans, F.array(last)), "struct<lo:bigint,hi:bigint,fresh:boolean>", F.lit(0).cast("long"), fuse), lambda p: p["fresh"])

    def cut(parts, p):
        first, final = F.floor(p["lo"] / STRETCH).cast("int"), F.floor(p["hi"] / STRETCH).cast("int")
        some = F.array_join(F.slice(parts, first + 1, F.least(final, F.size(parts) - 1) - first + 1), "")
        return F.when(p["hi"] > p["lo"], F.substr(some, (p["lo"] - first * STRETCH + 1).cast("int"), (p["hi"] - p["lo"]).cast("int"))).otherwise(F.lit(""))

    clean = let(stretches(F.col("text")), lambda parts: F.array_join(F.transform(kept, lambda p: cut(parts, p)), mark))
    out = scanned.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).drop(base, spans)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def op9_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda rank: F.size(F.filter("secret_base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")
    return found.select("doc_id", *map(number, range(3)), F.sha2(listed(F.col("secret_base")), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
