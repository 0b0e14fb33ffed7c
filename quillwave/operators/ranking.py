"""Positions in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.session import settle

# monotonically_increasing_id() is the partition number shifted by 33 bits
# plus the row number inside the partition.
_PART_BITS = 33
_ROW_MASK = (1 << _PART_BITS) - 1


def least_count(counted: DataFrame, count_col: str, most: int) -> int:
    """The lowest power of two that at most ``most`` rows reach in ``count_col``.

    Found from at most 64 counts of powers; no rows are sorted.
    """
    power = F.floor(F.log2(count_col)).alias("power")
    reached = 0
    for row in sorted(counted.groupBy(power).count().collect(), key=lambda r: -r["power"]):
        reached += row["count"]
        if reached > most:
            return 1 << (row["power"] + 1)
    return 1


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add the 1-based position of each row in ``order`` as ``out``.

    The rows are range partitioned and sorted inside the partitions. The
    layout is checkpointed because it is read twice: to count the partitions,
    and to add the row count of all earlier partitions. Only that count table,
    one row per partition, goes through a single task.
    """
    laid = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _PART_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW_MASK)) + 1)
        .drop("_part", "_before", "_at")
    )
