"""Similarity joins on token multisets, one-to-one matching, and accuracy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import tokens
from .rounds import cut


def elements(items: DataFrame) -> DataFrame:
    """doc_id, ord, size, element: the tokens of each item, a token's second occurrence being another element than its first.

    As sets of these, two items share as many elements as their multisets of tokens share tokens. size counts all of an
    item's tokens; an item without any has one row with a null element.
    """
    rows = items.select("doc_id", "ord", tokens("text").alias("t")).select("doc_id", "ord", F.size("t").alias("size"), F.explode_outer("t").alias("token"))
    rows = rows.groupBy("doc_id", "ord", "size", "token").agg(F.count("*").cast("int").alias("n"))
    number = F.explode_outer(F.when(F.col("token").isNotNull(), F.sequence(F.lit(1), "n")))
    return rows.select("doc_id", "ord", "size", "token", number.alias("k")).select("doc_id", "ord", "size", F.concat("token", F.lit(" "), F.col("k").cast("string")).alias("element"))


def least_shared(x: Column, y: Column, least: float) -> Column:
    """Elements that sets of sizes x and y share at least to reach the similarity; never too many for rounding's sake."""
    return F.ceil(F.lit(least / 2) * (x + y) - F.lit(1e-9))


def similar_pairs(expected: DataFrame, actual: DataFrame, least: float = V.MATCH) -> DataFrame:
    """doc_id, e, a, score: pairs of items of a document whose Dice similarity reaches ``least``.

    Both: doc_id, ord, text. A document's elements are put in order, rare ones first; two items that reach the similarity
    share an element of both their prefixes, as long as the rest cannot reach it alone. Only prefixes are listed, so an
    element that all items have makes no pairs unless they have little else; sizes and places rule out
    more before a pair is written, and each pair left is compared once. Items without tokens equal each other.
    """
    sides = elements(expected).withColumn("side", F.lit("e")).unionByName(elements(actual).withColumn("side", F.lit("a")))
    full = sides.where("element is not null")
    often = full.groupBy("doc_id", "element").agg(F.count("*").alias("n"))
    sets = full.join(often, ["doc_id", "element"]).groupBy("doc_id", "side", "ord", "size").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("found"))
    sets = cut(sets.withColumn("found", F.transform("found", lambda x: x["element"])))
    partner = F.ceil(F.lit(least / (2 - least)) * F.col("size") - F.lit(1e-9))  # the least size of a partner
    prefix = F.col("size") - F.greatest(F.lit(1), least_shared(F.col("size"), partner, least)) + 1
    lists = sets.select("doc_id", "side", "ord", "size", F.posexplode(F.slice("found", F.lit(1), prefix.cast("int"))).alias("at", "element"))
    x, y = lists.where("side = 'e'").alias("x"), lists.where("side = 'a'").alias("y")
    room = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))  # what they can share from here on
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.element") == F.col("y.element"))
    pairs = x.join(y, same & (room >= least_shared(F.col("x.size"), F.col("y.size"), least)))
    pairs = pairs.select("x.doc_id", F.col("x.ord").alias("e"), F.col("y.ord").alias("a")).distinct()
    of = lambda side, name: sets.where(F.col("side") == side).select("doc_id", F.col("ord").alias(side), F.col("size").alias(f"{name}_size"), F.col("found").alias(name))
    both = pairs.join(of("e", "xs"), ["doc_id", "e"]).join(of("a", "ys"), ["doc_id", "a"])
    scored = both.select("doc_id", "e", "a", (2.0 * F.size(F.array_intersect("xs", "ys")) / (F.col("xs_size") + F.col("ys_size"))).alias("score"))
    none = sides.where("element is null")
    bare = none.where("side = 'e'").select("doc_id", F.col("ord").alias("e")).join(none.where("side = 'a'").select("doc_id", F.col("ord").alias("a")), "doc_id").withColumn("score", F.lit(1.0))
    return scored.where(F.col("score") >= least).unionByName(bare)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """doc_id, e, a, score: the one-to-one matches taken in order of score, then e, then a.

    In rounds: a pair that is the best left of both its items is taken, and all pairs of these items go. The order is
    strict, so the pairs taken are those that one pass over all pairs in order would take; several are taken at once, in one
    document and in all. A document of any number of pairs is spread over tasks. Rounds grow with the longest chain of pairs
    of which each waits for the one before, at most with the matches of one document. Null scores match last; repeated pairs count once.
    """
    left = cut(pairs.groupBy("doc_id", "e", "a").agg(F.max("score").alias("score")))
    taken = None
    while not left.isEmpty():
        order = (-F.coalesce(F.col("score"), F.lit(float("-inf")))).alias("s")
        of_e = left.groupBy("doc_id", "e").agg(F.min(F.struct(order, "a")).alias("best")).select("doc_id", "e", F.col("best.a").alias("a"))
        of_a = left.groupBy("doc_id", "a").agg(F.min(F.struct(order, "e")).alias("best")).select("doc_id", F.col("best.e").alias("e"), "a")
        now = cut(left.join(of_e.join(of_a, ["doc_id", "e", "a"]), ["doc_id", "e", "a"], "left_semi"))
        taken = now if taken is None else taken.union(now)
        left = cut(left.join(now.select("doc_id", "e"), ["doc_id", "e"], "left_anti").join(now.select("doc_id", "a"), ["doc_id", "a"], "left_anti"))
    return left if taken is None else taken


def scores(expected: DataFrame, actual: DataFrame, tolerated: DataFrame | None = None) -> DataFrame:
    """doc_id, expected, found, misplaced, actual, unmapped, surplus of each document.

    expected, actual: doc_id, ord (long), domain, text. An unmatched item outside ``unmapped`` is
    surplus unless it resembles a tolerated text (doc_id, text) of a document that expects items.
    """
    matched = greedy_match(similar_pairs(expected, actual))
    placed = matched.join(expected.select("doc_id", F.col("ord").alias("e"), F.col("domain").alias("wanted")), ["doc_id", "e"]).join(actual.select("doc_id", F.col("ord").alias("a"), F.col("domain").alias("got")), ["doc_id", "a"])
    hits = placed.groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if(F.col("wanted") != F.col("got")).alias("misplaced"))
    rest = actual.join(matched.select("doc_id", F.col("a").alias("ord")), ["doc_id", "ord"], "left_anti").where(F.col("domain") != V.UNMAPPED)
    if tolerated is not None:
        fine = similar_pairs(tolerated.join(expected.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("ord", F.xxhash64("text")), rest.select("doc_id", "ord", "text"))
        rest = rest.join(fine.select("doc_id", F.col("a").alias("ord")).distinct(), ["doc_id", "ord"], "left_anti")
    extra = rest.groupBy("doc_id").agg(F.count("*").alias("surplus"))
    want = expected.groupBy("doc_id").agg(F.count("*").alias("expected"))
    have = actual.groupBy("doc_id").agg(F.count("*").alias("actual"), F.count_if(F.col("domain") == V.UNMAPPED).alias("unmapped"))
    out = want.join(have, "doc_id", "full_outer").join(hits, "doc_id", "left").join(extra, "doc_id", "left")
    return out.fillna(0, ["expected", "actual", "unmapped", "found", "misplaced", "surplus"])


def ratios(totals: DataFrame) -> DataFrame:
    """recall, precision, placement added to rows of counts; 1 where there is nothing to count."""
    part = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(F.round(a / b, 6))
    mapped = F.col("actual") - F.col("unmapped")
    return totals.withColumns({"recall": part(F.col("found"), F.col("expected")), "precision": part(mapped - F.col("surplus"), mapped), "placement": part(F.col("found") - F.col("misplaced"), F.col("found"))})


def pooled(counts: DataFrame) -> DataFrame:
    """Ratios of summed counts, over all documents: one row."""
    names = ("expected", "found", "misplaced", "actual", "unmapped", "surplus")
    return ratios(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]))
