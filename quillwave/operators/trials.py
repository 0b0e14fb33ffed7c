"""Operators on signal trials.

A trial table has one row per sample of a trial, with all channels of that
moment in one array: ``(trial, class, sample, values array<double>)``. Sums
over samples then combine inside the tasks, and channels never have to be
joined with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.functions.vectors import dot
from quillwave.operators.skew import DEFAULT_LIMITS, JoinLimits, attach_by_key

# Recordings left out for bad data.
EXCLUDED_SUBJECTS = (88, 92, 100)
# Runs 3-14 alternate between two tasks.
LEFT_RIGHT_RUNS = (3, 4, 7, 8, 11, 12)
FIST_FEET_RUNS = (5, 6, 9, 10, 13, 14)


def exclude_keys(df: DataFrame, key_col: str, excluded: tuple[int, ...] = EXCLUDED_SUBJECTS) -> DataFrame:
    return df.where(~F.col(key_col).isin(*excluded))


def task_classes(spark: SparkSession) -> DataFrame:
    """``(run, marker, task)`` for the 12 runs and 2 markers."""
    rows = [
        (run, marker, task)
        for runs, tasks in ((LEFT_RIGHT_RUNS, ("left", "right")), (FIST_FEET_RUNS, ("fist", "feet")))
        for run in runs
        for marker, task in zip(("T1", "T2"), tasks)
    ]
    return spark.createDataFrame(rows, "run int, marker string, task string")


def with_task_class(df: DataFrame) -> DataFrame:
    """Add ``task`` from ``run`` and ``marker``; rows of other markers go."""
    return df.join(F.broadcast(task_classes(df.sparkSession)), ["run", "marker"])


def to_long(trials: DataFrame) -> DataFrame:
    """``(trial, class, sample, channel, value)``, one row per number."""
    return trials.select(
        *[c for c in trials.columns if c != "values"], F.posexplode("values").alias("channel", "value")
    )


def to_wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """Channels of one moment as one array; ``keys`` name the moment."""
    cells = F.sort_array(F.collect_list(F.struct("channel", "value")))
    return long.groupBy(*keys).agg(F.transform(cells, lambda cell: cell["value"]).alias("values"))


def zscore(
    df: DataFrame,
    keys: list[str],
    value_col: str,
    *,
    out: str = "z",
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """(value - mean) / population deviation per key; NULL where that is 0."""
    stats = df.groupBy(*keys).agg(
        F.avg(value_col).alias("_mean"),
        F.stddev_pop(value_col).alias("_deviation"),
        F.count(F.lit(1)).alias("_n"),
    )
    joined = attach_by_key(df, stats, keys, limits=limits, null_safe=True)
    centred = F.col(value_col) - F.col("_mean")
    return joined.withColumn(out, F.try_divide(centred, F.col("_deviation"))).drop("_mean", "_deviation", "_n")


def channel_offsets(trials: DataFrame, trial_keys: list[str], class_col: str) -> DataFrame:
    """``(class, channel, offset)``: mean over trials of the trial's own mean."""
    return (
        to_long(trials.select(*trial_keys, class_col, "values"))
        .groupBy(class_col, *trial_keys, "channel")
        .agg(F.avg("value").alias("_mean"))
        .groupBy(class_col, "channel")
        .agg(F.avg("_mean").alias("offset"))
    )


def centre_channels(
    trials: DataFrame, trial_keys: list[str], class_col: str, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Subtract the channel offset of its class from each sample."""
    per_class = to_wide(
        channel_offsets(trials, trial_keys, class_col).withColumnRenamed("offset", "value"), [class_col]
    ).withColumnRenamed("values", "_offsets")
    joined = attach_by_key(trials, per_class, [class_col], limits=limits, null_safe=True)
    centred = F.zip_with("values", "_offsets", lambda value, offset: value - offset)
    return joined.withColumn("values", centred).drop("_offsets")


def product_sums(trials: DataFrame, class_col: str) -> DataFrame:
    """``(class, i, j, total)``: sum over samples of value_i * value_j.

    Every task adds the outer products of its own samples with one matrix
    product per batch and hands on one matrix per class.
    """
    class_type = trials.schema[class_col].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), type=key_type),
                    pa.array([m.shape[0] for m in sums.values()], type=pa.int32()),
                    pa.array([m.ravel() for m in sums.values()], type=pa.list_(pa.float64())),
                ],
                ["class", "width", "cells"],
            )
            sums.clear()
            return out

        for batch in batches:
            if batch.num_rows == 0:
                continue
            labels = batch.column(0)
            key_type = labels.type
            moments = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = np.array(labels.to_pylist(), dtype=object)
            for name in set(names):
                own = moments[names == name]
                sums[name] = sums.get(name, 0.0) + own.T @ own
            if len(sums) > 256:
                yield flush()
        if sums:
            yield flush()

    partials = trials.select(class_col, F.col("values").cast("array<double>")).mapInArrow(
        partial, f"class {class_type}, width int, cells array<double>"
    )
    cells = partials.select("class", "width", F.posexplode("cells").alias("_cell", "_value"))
    return (
        cells.groupBy("class", "width", "_cell")
        .agg(F.sum("_value").alias("total"))
        .select(
            F.col("class").alias(class_col),
            F.floor(F.col("_cell") / F.col("width")).cast("int").alias("i"),
            F.pmod("_cell", "width").cast("int").alias("j"),
            "total",
        )
    )


def class_covariance(trials: DataFrame, class_col: str) -> DataFrame:
    """``(class, i, j, value)``: product sums divided by their trace."""
    # One matrix (channels * channels cells) per window group.
    matrix = Window.partitionBy(class_col)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("total")).otherwise(F.lit(0.0))).over(matrix)
    return product_sums(trials, class_col).select(
        class_col, "i", "j", F.try_divide(F.col("total"), trace).alias("value")
    )


def project(values: Column, patterns: list[list[float]]) -> Column:
    """Patterns (components x channels) times the channels of one moment."""
    return F.array(*[dot(values, row) for row in patterns])


def log_variance(trials: DataFrame, keys: list[str], n_values: int) -> DataFrame:
    """``(keys, features)``: log of each component's share of the trial's energy."""
    energy = [F.sum(F.pow(F.get("values", F.lit(k)), F.lit(2))).alias(f"_e{k}") for k in range(n_values)]
    sums = trials.groupBy(*keys).agg(*energy)
    total = sum((F.col(f"_e{k}") for k in range(1, n_values)), F.col("_e0"))
    shares = [F.log(F.try_divide(F.col(f"_e{k}"), total)) for k in range(n_values)]
    return sums.select(*keys, F.array(*shares).alias("features"))


def spatial_patterns(
    trials: DataFrame, trial_keys: list[str], class_col: str, classes: tuple, num: int
) -> list[list[float]]:
    """Projection that best tells two classes apart by variance.

    The sums over all samples run on Spark. What reaches the driver is one
    offset vector and one channels x channels matrix per class; the
    eigenvectors of such a matrix are a small local step. Result: ``2 * num``
    rows of channel weights.
    """
    two = trials.where(F.col(class_col).isin(*classes))
    offsets = channel_offsets(two, trial_keys, class_col).collect()
    n_channels = 1 + max(row["channel"] for row in offsets)
    centre = {name: np.zeros(n_channels) for name in classes}
    for row in offsets:
        centre[row[class_col]][row["channel"]] = row["offset"]
    fixed = F.when(F.col(class_col) == classes[0], F.array(*map(F.lit, centre[classes[0]].tolist())))
    fixed = fixed.otherwise(F.array(*map(F.lit, centre[classes[1]].tolist())))
    centred = two.withColumn("values", F.zip_with("values", fixed, lambda v, o: v - o))

    covariance = {name: np.zeros((n_channels, n_channels)) for name in classes}
    for row in class_covariance(centred, class_col).collect():
        covariance[row[class_col]][row["i"], row["j"]] = row["value"]
    absent = [name for name in classes if not covariance[name].any()]
    if absent:
        raise ValueError(f"no variance in the trials of {absent}")
    return _patterns(covariance[classes[0]], covariance[classes[1]], num).tolist()


def _patterns(first: np.ndarray, second: np.ndarray, num: int) -> np.ndarray:
    """The ``num`` directions at each end of the share that ``first`` has in the joint variance.

    Directions without joint variance (relative to the largest) are left out;
    in the others the joint variance is scaled to 1, so both classes' shares
    come from one symmetric problem.
    """
    joint, axes = np.linalg.eigh(first + second)
    spanned = joint > joint.max() * first.shape[0] * np.finfo(float).eps
    scaled = axes[:, spanned] / np.sqrt(joint[spanned])
    _, directions = np.linalg.eigh(scaled.T @ first @ scaled)
    n = directions.shape[1]
    ends = [*range(min(num, n)), *range(max(n - num, 0), n)]
    return (scaled @ directions[:, ends]).T
