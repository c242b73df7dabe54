"""Votes, decisions, recall, order statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.functions import expressions as X
from nearfold.operators.ranks import values_at


def vote(neighbours: DataFrame, by: str = "q_id", label: str = "label", threshold: float = X.THRESHOLD) -> DataFrame:
    """(by, fraud_score, approved): the share of fraud among the neighbours there are, and whether it is below threshold."""
    score = F.sum(X.label_code(F.col(label))).cast("double") / F.count(F.lit(1))
    return neighbours.groupBy(by).agg(score.alias("fraud_score")).withColumn("approved", X.approved(F.col("fraud_score"), threshold))


def decide(requests: DataFrame, votes: DataFrame, by: str = "q_id") -> DataFrame:
    """Every request with its vote; one without neighbours, or that failed, is approved with score 0.0."""
    return (
        requests.join(votes, by, "left")
        .withColumn("fraud_score", F.coalesce("fraud_score", F.lit(0.0)))
        .withColumn("approved", F.coalesce("approved", F.lit(True)))
    )


def label_recall(exact: DataFrame, found: DataFrame, k: int = 5, by: str = "q_id") -> DataFrame:
    """(by, recall): how many of the exact neighbours' labels, as a multiset, the found ones have, over k."""
    count = lambda df, name: df.groupBy(by, "label").agg(F.count(F.lit(1)).alias(name))
    both = count(exact, "__e").join(count(found, "__f"), [by, "label"], "left")
    return both.groupBy(by).agg((F.sum(F.least("__e", F.coalesce("__f", F.lit(0)))).cast("double") / F.lit(float(k))).alias("recall"))


def order_statistics(values: DataFrame, column: str, by: list[str] | None = None, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """avg, p50, p90, p99, min and max; the p-th is the value at floor(n p) of the sorted ones, the last one at most.

    No group is sorted: see ranks.values_at.
    """
    by = by or []
    found = values_at(values, column, by, lambda n: [F.least(F.floor(n * F.lit(p)), n - 1) for p in shares])
    at = [F.max(F.when(F.col("nth") == k, F.col("value"))).alias(f"p{math.floor(p * 100 + 1e-9)}") for k, p in enumerate(shares)]
    placed = found.groupBy(*by).agg(*at)
    plain = values.where(F.col(column).isNotNull()).groupBy(*by).agg(F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"))
    names = [*by, "avg", *placed.columns[len(by) :], "min", "max"]
    if not by:
        return plain.crossJoin(placed).select(*names)
    both = plain.alias("a").join(placed.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by])
    return both.select(*[F.col(f"a.{k}").alias(k) for k in by], *names[len(by) :])


def running_offsets(counts: DataFrame, order: str, amount: Column) -> DataFrame:
    """``counts`` with ``byte_offset``: the sum of ``amount`` over the rows before, from 0."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("byte_offset", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long"))
