"""The stateless text steps on a streaming table.

They are the same column expressions as in a batch; a stream adds only its
source, its sink and a checkpoint for the progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions.text import clean_text, strip_noise_tokens
from quillwave.session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    """Parquet files of ``folder`` whose name fits ``pattern``, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table that is one file or a folder of files, as its files arrive."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return read_stream(spark, at.getParent().toString(), schema, at.getName())


def clean_stream(df: DataFrame, text_col: str, out: str = "clean_text") -> DataFrame:
    return df.withColumn(out, clean_text(strip_noise_tokens(F.col(text_col))))


def run_available(df: DataFrame, path: str) -> None:
    """Append everything that is there now to parquet files, then stop."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(df.sparkSession, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
