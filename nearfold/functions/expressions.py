"""Column expressions: features, distances, quantization, decisions.  All are built-in Catalyst expressions."""

from __future__ import annotations

import functools
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A strict RFC 3339 time: no blank instead of T, no date alone, an offset or Z at the end.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})$"
SENTINEL = 255
LEVELS = 254
FRAUD, LEGIT = "fraud", "legit"
THRESHOLD = 0.6
#: The dimensions in which "nothing known" comes back as -1 when values are put back from levels.
HISTORY_DIMS = (5, 6)


def clamp(x: Column) -> Column:
    """x held within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def guarded_ratio(amount: Column, average: Column, limit: float) -> Column:
    """The clamped ratio of an amount to an average over a limit; 1 where there is no positive average."""
    return F.when(average <= 0, F.lit(1.0)).otherwise(clamp(F.try_divide(F.try_divide(amount, average), F.lit(float(limit)))))


def instant(text: Column) -> Column:
    """The instant that a strict RFC 3339 text names, null for any other text."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def hour_of_day(text: Column) -> Column:
    """The hour on the clock of the text's own offset, over 23."""
    return F.when(instant(text).isNotNull(), F.substring(text, 12, 2).try_cast("int") / F.lit(23.0))


def day_of_week(text: Column) -> Column:
    """The weekday in the text's own offset, Monday 0 to Sunday 6, over 6."""
    return F.when(instant(text).isNotNull(), F.weekday(F.substring(text, 1, 10).try_cast("date")) / F.lit(6.0))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes with their fraction from one instant to another."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def flag(x: Column) -> Column:
    """1.0 for true, 0.0 for false."""
    return x.cast("int").cast("double")


def unknown_member(item: Column, known: Column) -> Column:
    """0.0 if the list has the item, 1.0 otherwise."""
    return F.when(F.array_contains(known, item), F.lit(0.0)).otherwise(F.lit(1.0))


def _at(v: Column, i: int, kind: str) -> Column:
    return F.get(v, F.lit(i)).cast(kind)


def squared_l2(a: Column, b: Column, dims: int, kind: str = "double") -> Column:
    """The squared distance, unrolled over ``dims`` and added from left to right; with kind "long" exact for levels."""
    d = [_at(a, i, kind) - _at(b, i, kind) for i in range(dims)]
    return functools.reduce(add, [x * x for x in d])


def squared_l2_folded(a: Column, b: Column) -> Column:
    """The same sum where the number of dimensions isn't known beforehand (slower: not in generated code)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, dims: int) -> Column:
    return functools.reduce(add, [_at(a, i, "double") * _at(b, i, "double") for i in range(dims)])


def squared_norm(a: Column, dims: int) -> Column:
    return dot(a, a, dims)


def rank_distance(v: Column, c: Column, norm: Column, dims: int) -> Column:
    """Orders centroids c like the squared distance to v does: the part |v|**2, equal for all, is left out."""
    return norm - F.lit(2.0) * dot(v, c, dims)


def quantize(v: Column) -> Column:
    """Levels 0 .. 254 of values in [0, 1], rounded half up; 255 for any negative value; values over 1 are held at 254."""
    level = lambda x: F.when(x < 0, F.lit(SENTINEL)).otherwise(F.least(F.lit(LEVELS), F.round(x.cast("double") * LEVELS).cast("int")))
    return F.transform(v, level)


def dequantize(levels: Column) -> Column:
    """Values of levels, over 255 (so 1.0 doesn't come back whole); 255 is -1 in the history dimensions, 1.0 elsewhere."""

    def value(x: Column, i: Column) -> Column:
        lost = F.when(i.isin(*HISTORY_DIMS), F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.when(x == SENTINEL, lost).otherwise(x / F.lit(255.0))

    return F.transform(levels, value)


def label_code(label: Column) -> Column:
    """1 for the fraud label, 0 for any other and for null."""
    return F.coalesce((label == FRAUD).cast("int"), F.lit(0))


def label_text(code: Column) -> Column:
    return F.when(code == 1, F.lit(FRAUD)).otherwise(F.lit(LEGIT))


def approved(score: Column, threshold: float = THRESHOLD) -> Column:
    return score < F.lit(threshold)
