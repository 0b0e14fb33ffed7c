"""Readers of delimited text, word vectors, recordings and single texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions.text import split_words, zero_padded
from quillwave.sources import folders

PHRASES = "PhraseId int, Phrase string, Sentiment int"
PHRASES_TEST = "PhraseId int, Phrase string"
TWEETS = "id int, text string, target int"
TWEETS_TEST = "id int, text string"
RECORDING = "t double, marker string, values array<double>, subject int, run int"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab separated, header, double quotes. ``None`` and ``NA`` stay text."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', nullValue="\x00")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma separated, header; quoted fields may hold commas and newlines."""
    return spark.read.csv(
        path, header=True, schema=schema, quote='"', escape='"', multiLine=True, nullValue="\x00",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector array<float>)`` from lines of a word and its numbers.

    If a word is repeated, its last line wins; lines are in order of file name,
    offset of the file block and line.
    """
    lines = spark.read.text(path).select(
        split_words(F.col("value")).alias("items"),
        F.struct(
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
    )
    return (
        lines.where(F.size("items") > 0)
        .select(
            F.col("items")[0].alias("word"),
            F.slice("items", F.lit(2), F.size("items")).cast("array<float>").alias("vector"),
            "place",
        )
        .groupBy("word")
        .agg(F.max_by("vector", "place").alias("vector"))
    )


def read_recordings(
    spark: SparkSession, path: str, runs: tuple[int, ...] = tuple(range(3, 15)), keep: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Decoded recordings, partitioned by subject and run; only ``runs`` are read.

    ``keep`` is a further filter on subject and run. Files it leaves out are
    not opened. The files of a tree with a list are found by the tasks; those
    of others by the driver, which holds them all.
    """

    def wanted(rows: DataFrame) -> DataFrame:
        return keep(rows.where(F.col("run").isin(*runs)))

    if folders.is_listed(spark, path):
        return folders.read(spark, path, RECORDING, wanted)
    return wanted(spark.read.schema(RECORDING).parquet(path))


def recording_name(df: DataFrame, out: str = "path") -> DataFrame:
    """Add the grid path ``S001/S001R03.edf`` of a subject and run."""
    subject = F.concat(F.lit("S"), zero_padded(F.col("subject"), 3))
    run = F.concat(F.lit("R"), zero_padded(F.col("run"), 2))
    return df.withColumn(out, F.concat(subject, F.lit("/"), subject, run, F.lit(".edf")))


def single_text(spark: SparkSession, text: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row, to score one sentence."""
    return spark.createDataFrame([(0, text)], f"{id_col} int, {text_col} string")
