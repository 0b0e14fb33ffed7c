"""Class profiles, duplicate texts and label repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.functions.text import text_digest
from quillwave.operators.skew import DEFAULT_LIMITS, JoinLimits, attach_by_key
from quillwave.session import settle


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, as ``(label, n)``."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of all rows per class, as ``(label, n, share)``."""
    everything = Window.partitionBy(F.lit(1))
    return class_counts(df, label).withColumn("share", F.col("n") / F.sum("n").over(everything))


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first ``n`` rows in id order."""
    return df.orderBy(id_col).limit(n)


def duplicate_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows but the first of each text.

    The first id of each text comes from an aggregate that is combined before
    the shuffle; the join is on the unique id, so a text with very many copies
    is never gathered.
    """
    firsts = df.groupBy(text_digest(F.col(text_col)).alias("_text")).agg(F.min(id_col).alias(id_col))
    return df.join(firsts.select(id_col), id_col, "left_anti")


def label_conflicts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows whose text also occurs with another label.

    Long form ``(first_id, id, label, n, first_label)``: one row per member of
    a conflict group, so a group of any size stays spread over tasks.
    """
    # Narrow rows, read twice: the texts are only scanned for the digest.
    keyed = settle(
        df.select(F.col(id_col), F.col(label_col), text_digest(F.col(text_col)).alias("_text"))
    )
    groups = (
        keyed.groupBy("_text")
        .agg(
            F.min(id_col).alias("first_id"),
            F.min_by(label_col, id_col).alias("first_label"),
            F.count(F.lit(1)).alias("n"),
            F.min(label_col).alias("_low"),
            F.max(label_col).alias("_high"),
        )
        .where((F.col("n") > 1) & (F.col("_low") != F.col("_high")))
        .drop("_low", "_high")
    )
    found = attach_by_key(keyed, groups, ["_text"], limits=limits)
    return found.select("first_id", id_col, label_col, "n", "first_label")


def apply_corrections(
    df: DataFrame, fixes: DataFrame, id_col: str, label_col: str, fix_col: str
) -> DataFrame:
    """Take the label of ``fixes`` (one row per id) where there is one."""
    renamed = fixes.select(id_col, F.col(fix_col).alias("_fix"))
    joined = df.join(renamed, id_col, "left")
    return joined.withColumn(label_col, F.coalesce("_fix", label_col)).drop("_fix")


def set_label(df: DataFrame, id_col: str, row_id: int, label_col: str, value: int) -> DataFrame:
    """Set the label of one row by hand."""
    return df.withColumn(
        label_col, F.when(F.col(id_col) == row_id, F.lit(value)).otherwise(F.col(label_col))
    )
