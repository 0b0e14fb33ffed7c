"""Column expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(length: int) -> Column:
    return F.array_repeat(F.lit(0.0), length)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda value: value * factor)


def ratio_or_zero(total: Column, count: Column) -> Column:
    """total / count, and 0 where that is undefined or NaN."""
    share = F.try_divide(total.cast("double"), count.cast("double"))
    return F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0))


def argmax(scores: Column) -> Column:
    """Position of the largest score, from 0; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(scores: Column, label: Column) -> Column:
    """-score[label] + log(sum(exp(score))), shifted by the maximum."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s.cast("double") - top))
    return F.log(total) + top - F.element_at(scores, label.cast("int") + 1)


def indicators(tokens: Column, keywords: list[str]) -> Column:
    """One 0/1 number per keyword: does the text contain it?"""
    return F.array(*[F.array_contains(tokens, word).cast("double") for word in keywords])


def pad_ids(ids: Column, length: int, pad_id: int = 0) -> Column:
    """Cut or fill an id array to exactly ``length`` items."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each real id, 0 for each filled one."""
    kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def dot(values: Column, weights: list[float]) -> Column:
    """Inner product of an array column and fixed numbers."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(
        F.zip_with(values, fixed, lambda v, w: v * w), F.lit(0.0), lambda acc, item: acc + item
    )
