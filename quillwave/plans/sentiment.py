"""Phrases -> mean word vectors -> classifier -> labels."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.operators.augment import synonym_augment
from quillwave.operators.models import fit, make_model, score, with_features
from quillwave.operators.split import exact_split
from quillwave.operators.vectors import mean_vectors
from quillwave.session import settle
from quillwave.sources.sinks import align_submission


def vectorise(
    df: DataFrame, id_col: str, text_col: str, vectors: DataFrame, dim: int, label_col: str | None = None
) -> DataFrame:
    """``(id[, label], vector, features)`` per text, written once."""
    out = mean_vectors(df, id_col, text_col, vectors, dim)
    if label_col:
        out = out.join(df.select(id_col, label_col), id_col)
    return with_features(settle(out))


def train_and_score(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    vectors: DataFrame,
    dim: int,
    *,
    model: str = "NN",
    n_classes: int = 5,
    dev_fraction: float = 0.1,
    seed: int = 42,
    **settings,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the train part; return the model and the scored dev part."""
    table = vectorise(df, id_col, text_col, vectors, dim, label_col)
    parts = exact_split(table, id_col, dev_fraction, seed=seed, out="is_dev")
    fitted = fit(parts.where("NOT is_dev"), make_model(model, dim, n_classes, **settings), label_col)
    return fitted, score(fitted, parts.where("is_dev"), id_col, label_col)


def train_and_evaluate(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    vectors: DataFrame,
    dim: int,
    *,
    model: str = "NN",
    n_classes: int = 5,
    dev_fraction: float = 0.1,
    seed: int = 42,
    **settings,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on the train part; return the model, all scored rows with ``part``, and ``(part, n, accuracy)``."""
    table = vectorise(df, id_col, text_col, vectors, dim, label_col)
    parts = settle(exact_split(table, id_col, dev_fraction, seed=seed, out="is_dev"))
    fitted = fit(parts.where("NOT is_dev"), make_model(model, dim, n_classes, **settings), label_col)
    named = parts.withColumn("part", F.when(F.col("is_dev"), "dev").otherwise("train"))
    scored = score(fitted, named, id_col, label_col, "part")
    right = (F.col("prediction") == F.col(label_col)).cast("double")
    log = scored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"))
    return fitted, scored, log


def augmented_train(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    weights: list[int],
    synonyms: DataFrame,
    *,
    dev_fraction: float = 0.1,
    seed: int = 42,
    stop_words: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split first, then oversample the train part only."""
    parts = exact_split(df, id_col, dev_fraction, seed=seed, out="is_dev")
    train = synonym_augment(
        parts.where("NOT is_dev"), id_col, text_col, label_col, weights, synonyms, stop_words=stop_words, seed=seed
    )
    return train, parts.where("is_dev").drop("is_dev")


def predict_submission(
    model: PipelineModel,
    test: DataFrame,
    template: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    vectors: DataFrame,
    dim: int,
) -> DataFrame:
    """Score the test texts and align the labels with the template's keys."""
    scored = score(model, vectorise(test, id_col, text_col, vectors, dim), id_col)
    return align_submission(template, scored.withColumnRenamed("prediction", label_col), id_col, label_col)
