"""Repeatable splits of exact size and oversampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.functions.text import repeatable_key


def exact_split(
    df: DataFrame,
    id_col: str,
    fraction: float,
    *,
    seed: int | str = 42,
    round_up: bool = True,
    out: str = "in_first",
    digits: int = 3,
    few: int = 1_000,
) -> DataFrame:
    """Flag exactly ceil (or floor) of ``fraction`` * n rows, chosen by hash.

    The rows are thought of in the order of a hash of their unique id; the
    first k are flagged. The cut is found by counts per ``digits`` more hex
    digits of the bucket it falls in (at most 16 ** digits rows), level by
    level until that bucket has ``few`` rows, which are sorted. The rows
    themselves are never shuffled: the flag is a comparison with a constant.
    NULL ids have no place in the order and are an error.
    """
    key = repeatable_key(seed, F.col(id_col))
    keyed = df.select(key.alias("_key"), F.col(id_col).alias("_id"))

    def histogram(edge: str) -> list[tuple[str, int]]:
        inside = keyed.where(F.col("_key").startswith(edge)) if edge else keyed
        prefix = F.substring("_key", 1, len(edge) + digits).alias("_prefix")
        counts = inside.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).collect()
        if any(row["_prefix"] is None for row in counts):
            raise ValueError(f"{id_col} is NULL in some rows; give every row an id before splitting")
        return sorted((row["_prefix"], row["n"]) for row in counts)

    buckets = histogram("")
    total = sum(n for _, n in buckets)
    wanted = math.ceil(fraction * total) if round_up else math.floor(fraction * total)
    if wanted <= 0 or wanted >= total:
        return df.withColumn(out, F.lit(wanted > 0))

    before = 0
    while True:
        for edge, n in buckets:
            if before + n >= wanted:
                break
            before += n
        # A bucket that no further digit divides is one key.
        if n <= few:
            break
        buckets = histogram(edge)
        if buckets == [(edge, n)]:
            break
    last = (
        keyed.where(F.col("_key").startswith(edge))
        .orderBy("_key", "_id")
        .limit(wanted - before)
        .agg(F.max(F.struct("_key", "_id")).alias("cut"))
        .first()["cut"]
    )
    at_cut = (key == last["_key"]) & (F.col(id_col) <= F.lit(last["_id"]))
    return df.withColumn(out, (key < last["_key"]) | at_cut)


def fast_split(df: DataFrame, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split whose sizes are only near the fraction, without any job."""
    first, second = df.randomSplit([fraction, 1.0 - fraction], seed)
    return first, second


def shuffled(df: DataFrame, id_col: str, seed: int | str = 42) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(repeatable_key(seed, F.col(id_col)), F.col(id_col))


def weight_of(label: Column, weights: list[int]) -> Column:
    """Weight at the class position; 0 for a class outside the list."""
    table = F.array(*[F.lit(int(w)) for w in weights])
    inside = (label >= 0) & (label < len(weights))
    return F.when(inside, F.element_at(table, label.cast("int") + 1)).otherwise(F.lit(0))


def oversample(df: DataFrame, label_col: str, weights: list[int], out: str = "copy") -> DataFrame:
    """Each row once as copy 0, and ``weights[label]`` more times (none where that is negative)."""
    extra = F.greatest(weight_of(F.col(label_col), weights), F.lit(0))
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), extra)))
