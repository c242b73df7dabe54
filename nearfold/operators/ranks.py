"""Values at given ranks without sorting everything: counts in bins first, then the few bins that hold a wanted rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def values_at(rows: DataFrame, column: str, by: list[str], ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, nth, value): of each group of ``rows`` the values at some ranks of its sorted values, from 0, nulls left out.

    ranks(n) gives the ranks for a group of n values; nth numbers them from 0.  The first pass takes bounds and counts, the
    second counts ``BINS`` bins a group, the third counts the different values of the bins with a wanted rank.  All three
    are partial sums, so no group's values come together in one task, and ties don't matter.
    """
    keys = by or ["__all"]
    rows = rows.where(F.col(column).isNotNull()).select(*([F.col(c) for c in by] or [F.lit(0).alias("__all")]), F.col(column).alias("__v"))
    bounds = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    # A bin's number goes up with the value, whatever is lost to rounding.
    width = F.col("__hi").cast("double") - F.col("__lo").cast("double")
    share = F.try_divide(F.col("__v").cast("double") - F.col("__lo").cast("double"), width)
    spot = F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    binned = rows.alias("r").join(bounds.alias("b"), same("r", "b")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "__v", spot.alias("__bin"), "__n")
    of_group = Window.partitionBy(*keys).orderBy("__bin")
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    counts = counts.withColumn("__below", F.sum("__c").over(of_group) - F.col("__c"))
    wanted = counts.select(*keys, "__bin", "__below", "__c", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("__n"))])).alias("nth", "__rank"))
    wanted = wanted.where("__rank >= __below AND __rank < __below + __c").select(*keys, "__bin", "nth", (F.col("__rank") - F.col("__below")).alias("__rank"))
    bins = wanted.select(*keys, "__bin").distinct()
    held = binned.alias("r").join(bins.alias("b"), [*same("r", "b"), F.col("r.__bin") == F.col("b.__bin")], "left_semi")
    values = held.groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c"))
    of_bin = Window.partitionBy(*keys, "__bin").orderBy("__v")
    values = values.withColumn("__to", F.sum("__c").over(of_bin))
    found = values.alias("r").join(wanted.alias("b"), [*same("r", "b"), F.col("r.__bin") == F.col("b.__bin")])
    found = found.where("__rank < __to AND __rank >= __to - r.__c")
    return found.select(*[F.col(f"r.{k}").alias(k) for k in by], "nth", F.col("__v").alias("value"))
