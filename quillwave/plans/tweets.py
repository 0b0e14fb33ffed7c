"""Audit of texts with disagreeing labels, and scoring with a loaded model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.functions.text import strip_noise_tokens
from quillwave.functions.vectors import argmax
from quillwave.operators.labels import apply_corrections, label_conflicts
from quillwave.operators.models import batch_scores
from quillwave.operators.vocabulary import encode_fixed_length


def strip_noise(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(text_col, strip_noise_tokens(F.col(text_col)))


def audit(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Members of the groups of equal noise-free texts whose labels differ."""
    return label_conflicts(strip_noise(df, text_col), id_col, text_col, label_col)


def equal_labels(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Give all equal texts the label of their first row."""
    conflicts = audit(df, id_col, text_col, label_col)
    return apply_corrections(df, conflicts, id_col, label_col, "first_label")


def classify(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    vocabulary: DataFrame,
    make_predict: Callable[[], Callable],
    *,
    length: int = 512,
    unknown_id: int = 1,
    **encoding,
) -> DataFrame:
    """``(id, label)`` from a model that takes fixed-length ids and masks."""
    encoded = encode_fixed_length(
        df, id_col, text_col, vocabulary, length, unknown_id=unknown_id, **encoding
    )
    scores = batch_scores(
        make_predict, F.col("input_ids"), F.col("attention_mask"), shapes=[[length], [length]]
    )
    return encoded.select(id_col, argmax(scores).alias(label_col))
