"""Quality rules over models: every breach is a row (doc_id, rule, domain, detail). No breach, no row.

Expectations are tables, joined by document and domain; items are never compared all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.headers import label_of
from ..functions.text import group_matches, norm_text, not_blank, starts_with_label, strip
from .items import groups_of, items

BREACH = ("doc_id", "rule", "domain", "detail")


def wording(models: DataFrame) -> DataFrame:
    """doc_id, domain, group_name, text, same: overview texts and items; unmapped ones are not placed and not here."""
    pairs = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"{d}.content").alias("text")) for d in V.OVERVIEW])
    flat = models.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.domain", F.lit("General").alias("group_name"), "p.text").where(not_blank("text"))
    rows = items(models, V.GRID).select("doc_id", "domain", F.coalesce(F.nullif("group_name", F.lit("")), F.lit("General")).alias("group_name"), "text")
    return flat.unionByName(rows).withColumn("same", norm_text("text"))


def breach(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), "domain", detail.alias("detail"))


def misplaced(models: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: doc_id, domain, group_name (null: any), needle, forbidden (domains). The needle must stand in its domain, in a
    group of such a name, and in no forbidden domain."""
    words = wording(models)
    want = expected.select("doc_id", "domain", F.col("group_name").alias("wanted"), "needle", norm_text("needle").alias("n"), F.coalesce("forbidden", F.expr("cast(array() as array<string>)")).alias("forbidden"))
    hit = words.join(want.select("doc_id", "domain", "wanted", "needle", "n"), ["doc_id", "domain"]).where(F.contains("same", F.col("n")) & (F.col("wanted").isNull() | group_matches("group_name", "wanted")))
    key = ("doc_id", "domain", "wanted", "needle")
    hit = hit.select(*[F.col(c).alias(f"hit_{c}") for c in key]).distinct()
    missing = want.join(hit, [F.col(c).eqNullSafe(F.col(f"hit_{c}")) for c in key], "left_anti")
    found = want.select("doc_id", "needle", "n", F.explode("forbidden").alias("domain")).join(words, ["doc_id", "domain"]).where(F.contains("same", F.col("n")))
    return breach(missing, "missing", F.col("needle")).union(breach(found.select("doc_id", "domain", "needle").distinct(), "forbidden", F.col("needle")))


def missing_groups(models: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: doc_id, domain, group_name. A domain must have a group of such a name, with items or without."""
    per_domain = F.array(*[F.struct(F.lit(d).alias("domain"), F.transform(groups_of(d), lambda g: g["name"]).alias("names")) for d in V.GROUPED])
    names = models.select("doc_id", F.explode(per_domain).alias("d")).select("doc_id", "d.*")
    rows = expected.join(names, ["doc_id", "domain"], "left")
    has = F.exists(F.coalesce("names", F.expr("cast(array() as array<string>)")), lambda n: F.coalesce(group_matches(n, F.col("group_name")), F.lit(False)))
    return breach(rows.where(~has), "group", F.col("group_name"))


def found_anywhere(models: DataFrame, needles: DataFrame) -> DataFrame:
    """needles: doc_id, needle. Wording that must stand in no domain."""
    want = needles.select("doc_id", "needle", norm_text("needle").alias("n"))
    rows = wording(models).join(want, "doc_id").where(F.contains("same", F.col("n")))
    return breach(rows.select("doc_id", "domain", "needle").distinct(), "fabricated", F.col("needle"))


def named_groups(models: DataFrame, domains: DataFrame) -> DataFrame:
    """domains: doc_id, domain. Groups with items that have a name where only General may be."""
    rows = items(models).join(domains, ["doc_id", "domain"]).where(norm_text(F.coalesce("group_name", F.lit("General"))) != "general")
    names = rows.groupBy("doc_id", "domain").agg(F.array_sort(F.collect_set(F.struct("group_ord", "group_name"))).alias("g"))
    return breach(names, "general_only", F.array_join(F.transform("g", lambda g: g["group_name"]), ", "))


def statement_breaches(models: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: doc_id, required, contains, must_not_be_in (arrays), not_duplicate (mission). Rules of the impact statement."""
    rows = expected.join(models.select("doc_id", strip(F.coalesce("impactStatement.content", F.lit(""))).alias("c"), norm_text(F.coalesce("mission.content", F.lit(""))).alias("m")), "doc_id")
    rows = rows.withColumns({"n": norm_text("c"), "wanted": F.transform(F.coalesce("contains", F.expr("cast(array() as array<string>)")), norm_text)})
    base = rows.withColumn("domain", F.lit("impactStatement"))
    absent = base.where(F.coalesce("required", F.lit(False)) & (F.col("c") == ""))
    lacks = base.select("doc_id", "domain", "n", F.explode(F.coalesce("contains", F.expr("cast(array() as array<string>)"))).alias("part")).where((F.col("n") != "") & ~F.contains("n", norm_text("part")))
    places = F.coalesce("must_not_be_in", F.expr("cast(array() as array<string>)"))
    mission = base.where(F.array_contains(places, "mission") & (F.col("m") != "") & F.exists("wanted", lambda w: F.contains(F.col("m"), w)))
    spread = rows.select("doc_id", "n", F.explode(places).alias("domain")).where("domain <> 'mission'").join(wording(models), ["doc_id", "domain"]).where(F.contains("same", F.col("n")))
    twin = base.where((F.col("not_duplicate") == "mission") & (F.col("n") != "") & (F.col("m") == F.col("n")))
    return (
        breach(absent, "statement_absent", F.lit("")).union(breach(lacks, "statement_lacks", F.col("part"))).union(breach(mission, "statement_in_mission", F.lit("")))
        .union(breach(spread.select("doc_id", "domain").distinct(), "statement_elsewhere", F.lit(""))).union(breach(twin, "statement_is_mission", F.lit("")))
    )


def empty_domains(models: DataFrame, domains: DataFrame) -> DataFrame:
    """domains: doc_id, domain. Domains that must have content and have none; the unmapped count too."""
    have = wording(models).select("doc_id", "domain").union(items(models, (V.UNMAPPED,)).select("doc_id", "domain")).distinct()
    return breach(domains.join(have, ["doc_id", "domain"], "left_anti"), "empty", F.lit(""))


def fixture_breaches(models: DataFrame, placements=None, groups=None, nowhere=None, general=None, statements=None, non_empty=None) -> DataFrame:
    """All rules at once; a table that is not given has no rule."""
    rules = [(misplaced, placements), (missing_groups, groups), (found_anywhere, nowhere), (named_groups, general), (statement_breaches, statements), (empty_domains, non_empty)]
    out = models.sparkSession.createDataFrame([], "doc_id string, rule string, domain string, detail string")
    for rule, table in rules:
        if table is not None:
            found = rule(models, table)
            out = out.union(found.select(F.col("doc_id").cast("string"), *BREACH[1:]))
    return out


def labels_of(text: Column) -> Column:
    """What stands before each joiner of a normalized text: the labels that the text may open with."""
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))), lambda i: F.substr(text, i, F.lit(1)).isin(*V.JOINERS))
    plain = F.transform(at, lambda i: F.substr(text, F.lit(1), i - 1))
    spaced = F.transform(F.filter(at, lambda i: (F.substr(text, i, F.lit(1)) != ":") & (F.substr(text, i - 1, F.lit(1)) == " ")), lambda i: F.substr(text, F.lit(1), i - 2))
    return F.array_distinct(F.concat(plain, spaced))


def nesting_breaches(models: DataFrame) -> DataFrame:
    """doc_id, kind, domain, group_name, text, example: items that repeat their group's name, and items that are the label of
    another item of their group (example: the first such).

    An item's possible labels meet the items of its group in an equi-join: a group is never paired with itself.
    """
    rows = items(models).withColumn("same", norm_text("text"))
    name = strip(F.coalesce("group_name", F.lit("")))
    own = rows.where((name != "") & (norm_text(name) != "general") & starts_with_label(F.col("text"), name))
    first = own.select("doc_id", F.lit("group_name_repeated_in_item").alias("kind"), label_of("domain", V.FIELD_LABELS).alias("domain"), name.alias("group_name"), "text", F.lit(None).cast("string").alias("example"))
    place = ["doc_id", "domain", "group_ord"]
    children = rows.select(*place, F.col("item_ord").alias("child_ord"), F.col("text").alias("child"), F.explode(labels_of(F.col("same"))).alias("same")).where("same <> ''")
    children = children.groupBy(*place, "same").agg(F.min_by("child", "child_ord").alias("example"))
    parents = rows.join(children, [*place, "same"])
    group = F.when(name == "", "General").otherwise(name)
    second = parents.select("doc_id", F.lit("parent_label_as_item").alias("kind"), label_of("domain", V.FIELD_LABELS).alias("domain"), group.alias("group_name"), "text", "example")
    return first.union(second)


def nesting_lines(breaches: DataFrame) -> DataFrame:
    """doc_id, line: a short line per breach."""
    place = F.concat_ws("/", "domain", "group_name")
    own = F.concat(place, F.lit(': item repeats its own group name — "'), "text", F.lit('"'))
    parent = F.concat(place, F.lit(': "'), "text", F.lit('" is a parent label emitted as its own item (cf. "'), "example", F.lit('")'))
    return breaches.select("doc_id", F.when(F.col("kind") == "group_name_repeated_in_item", own).otherwise(parent).alias("line"))
