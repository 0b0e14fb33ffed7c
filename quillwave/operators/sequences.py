"""Ordered operators per recording that do not need a recording in one task.

Each recording is cut into chunks by a function of its order column (an hour,
a day, a number of samples). Windows run inside a chunk. What has to cross a
chunk border is computed from one summary row per chunk and joined back.
Both the window and that join are on (recording, chunk), so the rows are
shuffled once, and a recording that holds a large part of all rows is spread
over as many tasks as it has chunks.

Recording keys and order columns must not be NULL; such rows have no place in
a sequence and are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _earlier(keys: list[str]):
    return (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )


def _chunked(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    # The joins on (recording, chunk) would add this filter on one side only;
    # stated here, both sides have it and can share one exchange.
    placed = reduce(and_, (F.col(c).isNotNull() for c in [*keys, "_chunk"]))
    return df.withColumn("_chunk", chunk).where(placed)


def minimum_before(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value_col: str, out: str
) -> DataFrame:
    """Add the minimum of ``value_col`` over all earlier rows of the recording."""
    rows = _chunked(df, keys, chunk)
    lowest = F.min(value_col)
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(lowest.alias("_own"))
        .select(*keys, "_chunk", F.min("_own").over(_earlier(keys)).alias("_carried"))
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.withColumn("_local", lowest.over(inside)).join(carried, [*keys, "_chunk"])
    return joined.withColumn(out, F.least("_local", "_carried")).drop("_local", "_carried", "_chunk")


def label_samples(
    samples: DataFrame,
    annotations: DataFrame,
    keys: list[str],
    *,
    time_col: str,
    onset_col: str,
    code_col: str,
    chunk: Callable[[Column], Column],
    end_col: str | None = None,
) -> DataFrame:
    """As-of join: each sample takes the code of the latest onset <= its time.

    NULL before the first onset. ``chunk`` maps a time column to a chunk. With
    ``end_col`` (onset + duration of an annotation) the samples at or past the
    end of the recording's last annotation are dropped.
    """
    time_type = annotations.schema[onset_col].dataType
    end = F.col(end_col) if end_col else F.lit(None).cast(time_type)
    row_type = samples.select(F.struct("*").alias("row")).schema["row"].dataType
    notes = _chunked(
        annotations.select(
            *keys,
            F.col(onset_col).alias("_t"),
            F.struct(F.col(code_col).alias("code"), end.alias("end")).alias("_note"),
        ),
        keys,
        chunk(F.col("_t")),
    )
    timed = _chunked(
        samples.select(*keys, F.col(time_col).alias("_t"), F.struct("*").alias("_row")), keys, chunk(F.col("_t"))
    )
    both = notes.select(
        "*", F.lit(None).cast(row_type).alias("_row"), F.lit(False).alias("_is_sample")
    ).unionByName(
        timed.select("*", F.lit(None).cast(notes.schema["_note"].dataType).alias("_note"), F.lit(True).alias("_is_sample"))
    )

    # One row per chunk: its last annotation, if it has one. Samples only tell
    # which chunks exist.
    newest = notes.groupBy(*keys, "_chunk").agg(F.max(F.struct("_t", "_note")).alias("_own"))
    present = timed.select(*keys, "_chunk").distinct()
    summary = newest.join(present, [*keys, "_chunk"], "full")
    whole = Window.partitionBy(*keys)
    carried = summary.select(
        *keys,
        "_chunk",
        F.last("_own._note", ignorenulls=True).over(_earlier(keys)).alias("_carried"),
        F.max("_own").over(whole)["_note"]["end"].alias("_end"),
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("_t", "_is_sample", "_note")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = (
        both.withColumn("_local", F.last("_note", ignorenulls=True).over(inside))
        .where("_is_sample")
        .join(carried, [*keys, "_chunk"])
        .where(F.col("_end").isNull() | (F.col("_t") < F.col("_end")))
    )
    return marked.select("_row.*", F.coalesce("_local", "_carried")["code"].alias(code_col))


def mark_runs(
    df: DataFrame, keys: list[str], order: list[str], marker_col: str, chunk: Column
) -> DataFrame:
    """Number the rows of each recording and find the runs of one marker.

    Adds ``position`` (1-based in the recording) and ``run_start`` (position
    of the first row of the run that the row belongs to).
    """
    chunk_keys = [*keys, "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy(*order)
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marker = F.col(marker_col)
    changed = (F.col("_at") > 1) & ~marker.eqNullSafe(F.lag(marker_col).over(inside))
    local = (
        _chunked(df, keys, chunk)
        .withColumn("_at", F.row_number().over(inside))
        .withColumn("_change", F.when(changed, F.col("_at")))
        .withColumn("_start", F.last("_change", ignorenulls=True).over(up_to_here))
    )
    earlier = _earlier(keys)
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    opens = F.lag("_n").over(by_chunk).isNull() | ~F.col("_head").eqNullSafe(F.lag("_tail").over(by_chunk))
    carried = (
        local.groupBy(*chunk_keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by(marker_col, "_at").alias("_head"),
            F.max_by(marker_col, "_at").alias("_tail"),
            F.max("_change").alias("_last_change"),
        )
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_opens", opens)
        .withColumn(
            "_last_start",
            F.col("_before") + F.coalesce("_last_change", F.when(F.col("_opens"), F.lit(1))),
        )
        .withColumn("_open_start", F.last("_last_start", ignorenulls=True).over(earlier))
        .select(
            *chunk_keys,
            "_before",
            F.when(F.col("_opens"), F.col("_before") + 1).otherwise(F.col("_open_start")).alias("_entry"),
        )
    )
    return (
        local.join(carried, chunk_keys)
        .withColumn("position", F.col("_before") + F.col("_at"))
        .withColumn("run_start", F.coalesce(F.col("_before") + F.col("_start"), F.col("_entry")))
        .drop("_chunk", "_at", "_change", "_start", "_before", "_entry")
    )


def run_lengths(marked: DataFrame, keys: list[str], marker_col: str) -> DataFrame:
    """``(keys, run_start, marker, n)``: one row per run."""
    return marked.groupBy(*keys, "run_start", marker_col).agg(F.count(F.lit(1)).alias("n"))


def first_of_runs(marked: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` .. ``end`` - 1 (from 0) of each run of >= end - start rows.

    Rows past ``end`` are dropped first, so a window group has at most ``end``
    rows however long its run is. Adds ``sample``, from 0 at ``start``.
    """
    within = F.col("position") - F.col("run_start")
    head = marked.withColumn("_within", within).where(F.col("_within") < end)
    run = Window.partitionBy(*keys, "run_start")
    return (
        head.withColumn("_n", F.count(F.lit(1)).over(run))
        .where((F.col("_n") >= end - start) & (F.col("_within") >= start))
        .withColumn("sample", F.col("_within") - start)
        .drop("_within", "_n")
    )
