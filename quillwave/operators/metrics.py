"""Accuracy, loss, epoch logs and the choice of the best model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.functions.vectors import argmax, cross_entropy
from quillwave.operators.sequences import minimum_before


def accuracy(df: DataFrame, prediction_col: str, label_col: str) -> DataFrame:
    """One row: share of rows where both are equal."""
    same = (F.col(prediction_col) == F.col(label_col)).cast("double")
    return df.agg(F.avg(same).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def mean_cross_entropy(df: DataFrame, scores_col: str, label_col: str) -> DataFrame:
    """One row: mean over rows of the loss computed from raw scores."""
    loss = cross_entropy(F.col(scores_col), F.col(label_col))
    return df.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def evaluate_parts(df: DataFrame, part_col: str, scores_col: str, label_col: str) -> DataFrame:
    """``(part, n, loss, accuracy)``: loss and accuracy of raw scores per part, in one pass.

    Rows without scores or a label take no part.
    """
    used = df.where(F.col(scores_col).isNotNull() & F.col(label_col).isNotNull())
    loss = cross_entropy(F.col(scores_col), F.col(label_col))
    right = (argmax(F.col(scores_col)) == F.col(label_col)).cast("double")
    return used.groupBy(part_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("accuracy")
    )


def epoch_log(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per epoch of a log with ``batch_loss, batch_rows, batch_correct``.

    ``loss_per_row`` divides the sum of batch means by the number of rows, as
    the training scripts print it; ``mean_loss`` divides by the batches.
    """
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("batch_rows").alias("n_rows"),
        (F.sum("batch_loss") / F.sum("batch_rows")).alias("loss_per_row"),
        F.avg("batch_loss").alias("mean_loss"),
        (F.sum("batch_correct") / F.sum("batch_rows")).alias("accuracy"),
    )


def best_checkpoint(
    log: DataFrame, keys: list[str], model_col: str, loss_col: str, epoch_col: str
) -> DataFrame:
    """Per key the model of the lowest loss; the earliest epoch on ties."""
    best = F.min(F.struct(F.col(loss_col), F.col(epoch_col), F.col(model_col))).alias("_best")
    return log.groupBy(*keys).agg(best).select(
        *keys,
        F.col(f"_best.{model_col}").alias(model_col),
        F.col(f"_best.{epoch_col}").alias(epoch_col),
        F.col(f"_best.{loss_col}").alias(loss_col),
    )


def running_best(
    log: DataFrame, keys: list[str], epoch_col: str, loss_col: str, chunk: Column
) -> DataFrame:
    """Add the lowest loss of all earlier epochs, and whether this one is lower."""
    out = minimum_before(log, keys, [epoch_col], chunk, loss_col, "best_before")
    better = F.col("best_before").isNull() | (F.col(loss_col) < F.col("best_before"))
    return out.withColumn("improved", better)
