"""Recordings -> labelled samples -> segments -> spatial features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.operators.joint_patterns import joint_patterns
from quillwave.operators.sequences import first_of_runs, label_samples, mark_runs
from quillwave.operators.trials import (
    exclude_keys,
    log_variance,
    project,
    spatial_patterns,
    with_task_class,
)

SAMPLE_RATE = 160


def hourly(t: Column) -> Column:
    """Chunk of a time in seconds: one hour, 576,000 samples at 160 Hz."""
    return F.floor(t / 3600)


def segment(
    samples: DataFrame,
    annotations: DataFrame,
    *,
    time_range: tuple[float, float] = (0, 4),
    sample_rate: int = SAMPLE_RATE,
    chunk=hourly,
) -> DataFrame:
    """Trials ``(subject, run, trial, task, sample, values)``.

    ``samples`` is ``(subject, run, t, values)``; ``annotations`` is
    ``(subject, run, onset, duration, code)``. A trial is the fixed-size head
    of each run of marker T1 or T2 that is long enough; its number is the
    position of its first sample in the recording.
    """
    keys = ["subject", "run"]
    start, end = (int(sample_rate * edge) for edge in time_range)
    kept = exclude_keys(samples, "subject")
    notes = annotations.withColumn("until", F.col("onset") + F.col("duration"))
    labelled = label_samples(
        kept.withColumn("t", F.round("t", 5)), notes, keys,
        time_col="t", onset_col="onset", code_col="code", chunk=chunk, end_col="until",
    ).withColumnRenamed("code", "marker")
    marked = mark_runs(labelled, keys, ["t"], "marker", chunk(F.col("t")))
    wanted = marked.where(F.col("marker").isin("T1", "T2"))
    cut = first_of_runs(wanted, keys, start, end)
    return with_task_class(cut).select(
        *keys, F.col("run_start").alias("trial"), "task", "sample", "values"
    )


def csp_features(trials: DataFrame, keys: list[str], class_col: str, classes: tuple, num: int) -> DataFrame:
    """Learn patterns on two or more classes and describe each of their trials.

    ``keys`` name a trial; result ``(keys, class, features)``. Two classes get
    ``num`` features from either end, more classes ``num`` features each.
    """
    learn = spatial_patterns if len(classes) == 2 else joint_patterns
    patterns = learn(trials, keys, class_col, classes, num)
    projected = trials.where(F.col(class_col).isin(*classes)).withColumn(
        "values", project(F.col("values"), patterns)
    )
    return log_variance(projected, [*keys, class_col], len(patterns))
