"""Writers of submissions, delimited text and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.sources import folders


def align_submission(template: DataFrame, predictions: DataFrame, key: str, label: str) -> DataFrame:
    """Template keys with the predicted labels, joined by key."""
    return template.select(key).join(predictions.select(key, label), key, "left")


def write_submission(df: DataFrame, path: str, key: str, label: str, single_file: bool = False) -> None:
    """CSV with header, key and integer label.

    ``single_file`` is for the hand-in of a competition: two integers per row
    in key order in one file.
    """
    out = df.select(key, F.col(label).cast("int").alias(label))
    if single_file:
        out = out.repartition(1).sortWithinPartitions(key)
    out.write.csv(path, header=True)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header, double quotes doubled inside quoted fields, text kept as it is."""
    df.write.csv(
        path, sep=sep, header=True, quote='"', escape='"', nullValue="\x00", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """One line per word: the word and its numbers, separated by spaces."""
    line = F.concat_ws(" ", "word", F.array_join(F.col("vector").cast("array<string>"), " "))
    vectors.select(line.alias("value")).write.text(path)


def write_recordings(samples: DataFrame, path: str) -> None:
    """One folder per subject and run, at a new ``path``.

    The rows of a folder meet in one task, so it holds one file. The number of
    tasks is a fixed one, as the time goes with the folders: by size, adaptive
    execution would leave many small ones to one task. Tasks write the files
    and list them in a table, so the driver does not know the folders. Readers
    must wait for the end of the write; files that are added later are not in
    the list.

    On a file system that Arrow does not know, Spark writes them. Tasks put
    their own files in place: the driver would move those of many folders one
    by one. It holds the names of all folders.
    """
    if folders.reached(samples.sparkSession, path):
        folders.write(samples, path)
        return
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = samples.repartition(tasks, "subject", "run")
    writer = laid.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("subject", "run").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
