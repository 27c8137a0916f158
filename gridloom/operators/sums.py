"""Sums of doubles that are rounded once, whatever the order and the partitions of the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Binary places of one bin; a bin's sum holds some 10^12 rows.
BITS = 32


def scaled(x: Column, places: Column) -> Column:
    """x times a power of two, in two steps that neither overflow nor lose bits."""
    half = F.floor(places / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), places - half)


def accumulated(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, bin, total, special: what the values come to, by bins of their exponents. Null and zero values add nothing.

    total is a whole number of units of 2^(32 * bin); special counts infinities (1, -1) and others that are no numbers (0) in a row of
    their own. Sums of such rows by keys, bin and special are again such rows, so partial results may be kept and merged in any order.
    """
    x = F.col(value).cast("double")
    odd = F.when(F.isnan(x), 0).when(x == float("inf"), 1).when(x == float("-inf"), -1)
    rows = rows.where(x.isNotNull() & (x != 0)).select(*keys, x.alias("x_"), odd.alias("special"))
    e = F.when(F.col("special").isNull(), F.floor(F.log2(F.abs("x_"))))
    rows = rows.withColumn("e_", e).withColumn("m_", F.when(F.col("special").isNull(), scaled(F.col("x_"), 53 - F.col("e_"))).otherwise(1.0).cast("long"))
    place = F.coalesce(F.col("e_") - 53, F.lit(0))
    at = F.floor(place / BITS)
    units = F.col("m_").cast("decimal(20,0)") * F.pow(F.lit(2.0), place - BITS * at).cast("decimal(10,0)")
    return rows.groupBy(*keys, at.cast("int").alias("bin"), "special").agg(F.sum(units).cast("decimal(38,0)").alias("total"))


@F.pandas_udf(DoubleType())
def rounded(bins: pd.Series, totals: pd.Series) -> pd.Series:
    """The double nearest to each list of bins."""

    def one(at, found) -> float:
        least = min(at)
        whole = sum(int(n) << BITS * (b - least) for b, n in zip(at, found))
        try:
            return float(whole << BITS * least) if least >= 0 else whole / (1 << -BITS * least)
        except OverflowError:
            return float("inf") if whole > 0 else float("-inf")

    return pd.Series([one([int(b) for b in at], found) if len(at) else 0.0 for at, found in zip(bins, totals)])


def exact_sums(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, total: the sum of each group's values, rounded once to the nearest double.

    A group has a bin for each 32 binary places at most, 67 in all, which are put together at the end. Values that are no numbers, or
    infinities of both signs, give NaN, infinities of one sign themselves. Groups whose values are all null or zero give 0; without keys
    and rows there is one row, 0.
    """
    bins = accumulated(rows, value, *keys)
    special, plain = F.col("special").isNotNull(), F.col("special").isNull()
    parts = bins.groupBy(*keys).agg(
        F.collect_list(F.when(plain, F.col("bin"))).alias("bins"), F.collect_list(F.when(plain, F.col("total").cast("string"))).alias("totals"),
        F.collect_set(F.when(special, F.col("special"))).alias("odd"),
    )
    one = F.get(F.col("odd"), F.lit(0))
    total = F.when(F.size("odd") == 0, rounded("bins", "totals")).when((F.size("odd") > 1) | (one == 0), float("nan")).when(one == 1, float("inf")).otherwise(float("-inf"))
    out = parts.select(*keys, total.alias("total"))
    return rows.select(*keys).distinct().join(out, [*keys], "left").withColumn("total", F.coalesce("total", F.lit(0.0))) if keys else out
