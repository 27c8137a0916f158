"""Headers to columns, by the fixed synonyms; the 30 entries are one literal map, or a table for joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V
from .text import bare_header, col, norm_header


#: Key to (rank, domain): a longer key comes first, of equally long ones the one that is listed first.
RANKED = {key: (i, domain) for i, (key, domain) in enumerate(sorted(V.SYNONYMS, key=lambda s: -len(s[0])))}
KEY_WORDS = max(len(key.split(" ")) for key in RANKED)


def key_forms(header: Column | str, bare: Column | str) -> Column:
    """All that a key may be of a header: what it opens or closes with, up to as many words as keys have (the whole
    header, if it has no more), and its bare form. Keys are then met by equality alone."""
    n = col(header)
    ends = [F.substring_index(n, " ", sign * k) for k in range(1, KEY_WORDS + 1) for sign in (1, -1)]
    return F.array(*ends, col(bare))


def synonym_of(header: Column | str, bare: Column | str) -> Column:
    """Loose: the longest key that a header equals, opens with or closes with; null for none.

    header, bare: its normalized and its bare form, best as columns computed before: each is read often.
    """
    ranks = F.create_map(*[x for key, (rank, domain) in RANKED.items() for x in (F.lit(key), F.struct(F.lit(rank).alias("rank"), F.lit(domain).alias("domain")))])
    return F.array_min(F.transform(key_forms(header, bare), lambda form: F.try_element_at(ranks, form)))["domain"]


def column_of(bare: Column | str) -> Column:
    """Strict: the column whose name a bare header is; null for none."""
    names = F.create_map(*[F.lit(x) for pair in V.SYNONYMS for x in pair])
    return F.try_element_at(names, col(bare))


def synonym_domain(label: Column | str) -> Column:
    return synonym_of(norm_header(label), bare_header(label))


def column_domain(label: Column | str) -> Column:
    return column_of(bare_header(label))


def is_input_subbucket(label: Column | str) -> Column:
    return norm_header(label).isin(*V.INPUT_SUBBUCKETS)


def label_of(domain: Column | str, labels: dict = V.LABELS) -> Column:
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(names, F.col(domain) if isinstance(domain, str) else domain)


def domain_dimension(spark: SparkSession) -> DataFrame:
    """domain, label, ord, is_grid, is_structure, is_result, is_coding."""
    rows = [(d, V.LABELS[d], i, d in V.GRID, d in V.STRUCTURE, d in V.RESULTS, d in V.CODING) for i, d in enumerate(V.GROUPED)]
    return spark.createDataFrame(rows, "domain string, label string, ord int, is_grid boolean, is_structure boolean, is_result boolean, is_coding boolean")


def synonym_dimension(spark: SparkSession) -> DataFrame:
    """key, domain, rank of the fixed synonyms: 30 rows, for joins."""
    return spark.createDataFrame([(key, domain, rank) for key, (rank, domain) in RANKED.items()], "key string, domain string, rank int")
