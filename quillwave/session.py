"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Return the checkpoint folder of this session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillwave-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


_HANDED_OUT: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Remove all scratch tables of this driver, at the end of its work; returns how many there were.

    Results that still read one of them must have been written elsewhere.
    """
    removed = 0
    while _HANDED_OUT:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_HANDED_OUT.pop())
        removed += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there.

    Used where a result must not change between two reads of it (partition
    numbers), or where a small aggregate is needed several times.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
