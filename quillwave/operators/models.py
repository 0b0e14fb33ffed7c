"""Classifiers chosen by name, and batch scoring with a user's own model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.storagelevel import StorageLevel

from quillwave.operators.kernel_svm import CosineFeatures


def linear_svm(dim: int, n_classes: int, *, max_iter: int = 30, reg: float = 1e-3) -> Estimator:
    """One linear separator per class."""
    return OneVsRest(
        classifier=LinearSVC(maxIter=max_iter, regParam=reg), parallelism=min(n_classes, 4)
    )


def perceptron(
    dim: int, n_classes: int, *, hidden: tuple[int, ...] = (128, 32), max_iter: int = 60, seed: int = 42
) -> Estimator:
    """Fully connected network with the given hidden layers."""
    return MultilayerPerceptronClassifier(layers=[dim, *hidden, n_classes], maxIter=max_iter, seed=seed)


MODELS: dict[str, Callable[..., Estimator]] = {"SVM": linear_svm, "NN": perceptron}


def make_model(name: str, dim: int, n_classes: int, **settings) -> Estimator:
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](dim, n_classes, **settings)


def with_features(df: DataFrame, vector_col: str = "vector", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector_col).cast("array<double>")))


def fit(
    train: DataFrame, estimator: Estimator, label_col: str = "label", rows_per_task: int = 20_000
) -> PipelineModel:
    """Fit on ``features`` and an integer label.

    The iterations read the rows many times, so they are kept in memory with
    overflow to disk. Every iteration is one job: partitions far below
    ``rows_per_task`` are read together so that tasks are not mostly overhead.
    """
    label = SQLTransformer(statement=f"SELECT *, CAST(`{label_col}` AS DOUBLE) AS _label FROM __THIS__")
    estimator = estimator.copy().setLabelCol("_label").setFeaturesCol("features")
    kept = train.select("features", label_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = max(1, -(-kept.count() // rows_per_task))
        return Pipeline(stages=[label, estimator]).fit(kept.coalesce(tasks))
    finally:
        kept.unpersist()


def score(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and an integer ``prediction``."""
    # The fitted stages after the label cast; test rows need no label.
    scored = df
    for stage in model.stages:
        if not isinstance(stage, SQLTransformer):
            scored = stage.transform(scored)
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def fourier_features(vector: Column, dim: int, n_features: int, gamma: float, seed: int = 42) -> Column:
    """Random cosine features whose inner products approach the kernel
    exp(-gamma * |x - y|^2) (Rahimi and Recht, 2007)."""
    return CosineFeatures(dim, n_features, gamma, seed).of(vector)


def batch_scores(
    make_predict: Callable[[], Callable], *inputs: Column, shapes: list[list[int]], batch_size: int = 256
) -> Column:
    """Class scores from a user's model.

    ``make_predict`` runs once per Python worker and returns a function from
    NumPy batches to a (rows x classes) score array, for example a loaded
    network that takes ids and masks.
    """
    scorer = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=shapes
    )
    return scorer(*inputs)


def apply_series(series: Column, function: Callable[[pd.Series], pd.Series], return_type: str) -> Column:
    """Hook for a user's own vectorised function on a column."""
    return F.pandas_udf(function, return_type)(series)
