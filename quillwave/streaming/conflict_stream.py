"""Duplicate texts and label conflicts kept up to date as rows arrive.

The state of a text is its first id, the label of that row, the number of rows
and the range of labels, held by Spark's streaming aggregation under the
digest of the text: rows are combined before the shuffle, so a text that makes
up a third of a batch is one row per task. Every micro-batch writes the groups
that it changed; the last version of a group corrects what earlier ones said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillwave.functions.text import text_digest
from quillwave.operators.skew import attach_by_key
from quillwave.streaming import batch_files

GROUPS = "text_key binary, first_id long, first_label int, n long, low int, high int"


def group_state(rows: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(text_key, first_id, first_label, n, low, high)`` per text, of a table or a stream."""
    label = F.col(label_col).cast("int")
    return rows.groupBy(text_digest(F.col(text_col)).alias("text_key")).agg(
        F.min(F.col(id_col).cast("long")).alias("first_id"),
        F.min_by(label, F.col(id_col).cast("long")).alias("first_label"),
        F.count(F.lit(1)).alias("n"),
        F.min(label).alias("low"),
        F.max(label).alias("high"),
    )


def keep_groups(stream: DataFrame, id_col: str, text_col: str, label_col: str, path: str, progress: str, **running) -> StreamingQuery:
    """Write the changed groups of every micro-batch."""
    changed = group_state(stream, id_col, text_col, label_col)
    return batch_files.start(changed, lambda batch: batch, path, progress, mode="update", **running)


def current_groups(spark: SparkSession, path: str, progress: str) -> DataFrame:
    """The last version of every group."""
    versions = batch_files.read(spark, path, progress, spark.createDataFrame([], GROUPS).schema)
    values = [c for c in versions.columns if c not in ("text_key", "batch")]
    last = versions.groupBy("text_key").agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select("text_key", "_last.*")


def conflicts(rows: DataFrame, groups: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(first_id, id, label, n, first_label)`` of the rows whose text has several labels."""
    open_groups = groups.where((F.col("n") > 1) & (F.col("low") != F.col("high"))).drop("low", "high")
    keyed = rows.select(id_col, label_col, text_digest(F.col(text_col)).alias("text_key"))
    return attach_by_key(keyed, open_groups, ["text_key"]).select("first_id", id_col, label_col, "n", "first_label")


def repeated(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """All rows but the first of each text."""
    return rows.join(groups.select(F.col("first_id").alias(id_col)), id_col, "left_anti")
