"""Joins of many rows to one row per key that survive hot keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.session import settle


@dataclass(frozen=True)
class JoinLimits:
    """``broadcast_rows``: the largest key table that is broadcast.

    Such a table has a key and a few numbers per row, so this is some tens of MB.
    """

    broadcast_rows: int = 500_000


DEFAULT_LIMITS = JoinLimits()


def fits(table: DataFrame, max_rows: int) -> bool:
    """True if ``table``, a settled one, has at most ``max_rows`` rows."""
    return table.count() <= max_rows


# Characters of text in a partition, so that what a task holds does not grow with the table.
PARTITION_CHARS = 4 << 20


def text_partitions(df: DataFrame, text_col: str) -> int:
    """Partitions of about ``PARTITION_CHARS`` for the texts of ``df``, and no fewer than there are cores."""
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // PARTITION_CHARS))


def attach_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    *,
    how: str = "inner",
    limits: JoinLimits = DEFAULT_LIMITS,
    settled: bool = False,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``table`` (one row per key) to ``rows``.

    A small table is counted and broadcast. A larger one is joined by shuffle.
    Both sides are then plain exchanges, so adaptive execution splits the rows
    of any hot key over several tasks, whatever their number.

    ``settled`` says that ``table`` has been written already; ``null_safe``
    that a NULL key is a key like any other.
    """
    if not settled:
        table = settle(table)
    small = fits(table, limits.broadcast_rows)
    if null_safe:
        table = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        on = [rows[k].eqNullSafe(table[f"_key_{k}"]) for k in keys]
    else:
        on = keys
    joined = rows.join(F.broadcast(table) if small else table, on, how)
    return joined.drop(*[f"_key_{k}" for k in keys]) if null_safe else joined
