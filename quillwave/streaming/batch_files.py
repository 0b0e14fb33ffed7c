"""Micro-batches as folders of files, each written exactly once.

Batch n goes to ``path/batch=n`` and replaces what an earlier try of the same
batch left there: after a failure Spark runs the batch again under the same
number with the same rows. Readers take only batches that the progress log
calls committed, so they never see half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def start(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    progress: str,
    *,
    mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and write its rows.

    ``progress`` is the folder of the progress log; a later start with the same
    one goes on after the last committed batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", progress)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def committed(spark: SparkSession, progress: str) -> list[int]:
    """Numbers of the batches that are complete, from the progress log."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits")
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def read(spark: SparkSession, path: str, progress: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches, with their ``batch`` number.

    The log keeps the latest batches by name; the ones before the first of
    them are complete as well.
    """
    done = committed(spark, progress)
    whole = StructType(list(schema.fields)).add("batch", "long")
    if not done:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", path).parquet(path)
    return rows.where(F.col("batch") <= done[-1])
