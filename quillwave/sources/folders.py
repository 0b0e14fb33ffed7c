"""Trees of one folder per subject and run, with a list of their files.

Spark keeps all folders of a tree that it writes, and all files of one that it
reads, in the driver's memory. Here tasks write the files and note them in a
table, ``_files`` in the tree; tasks take that table and open the files. The
driver knows neither folders nor files. Folders are named as Spark names them
and Spark's own reader takes the tree too: it skips names with an underscore.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillwave.sources.recordings import store

# ``parts`` is the number of row groups of a file; a task reads one.
LISTED = "file string, subject string, run string, parts int"

# Spark's folder of nulls, and the characters that it escapes in the name of a folder.
_NOBODY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
# Leaves the mark of a write that has ended.
_MARKED = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
_BATCH_ROWS, _BATCH_BYTES = 10_000, 4 << 20


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path with its scheme."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(named)


def reached(spark: SparkSession, path: str) -> bool:
    """Can tasks open files below ``path`` themselves: does Arrow know the file system?"""
    try:
        store(_hadoop(spark, path)[1].toString())
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def is_listed(spark: SparkSession, path: str) -> bool:
    """Was the tree written here, and to its end?"""
    system, whole = _hadoop(spark, path)
    return system.exists(spark._jvm.org.apache.hadoop.fs.Path(whole, "_files/_SUCCESS"))


def _tasks(spark: SparkSession) -> int:
    """A fixed number, as the time goes with the files: by size, adaptive execution would leave many small ones to one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _value(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(text != "", text).otherwise(_NOBODY)


def write(samples: DataFrame, path: str, group_bytes: int = 32 << 20) -> None:
    """One file per subject and run at a new ``path``, written by the task in which its rows meet.

    A file gets its name when it is whole, so a task that is run again replaces
    those of its failed try. It has row groups of ``group_bytes``.
    """
    spark = samples.sparkSession
    # Refuses a path that exists, as the write of a table does.
    first = samples.limit(0).write.option(_MARKED, "false")
    first.partitionBy("subject", "run").parquet(path)
    system, root = _hadoop(spark, path)
    whole = root.toString()
    keyed = samples.withColumn("_key", F.concat_ws("\x00", _value("subject"), _value("run"))).drop("subject", "run")
    laid = keyed.repartition(_tasks(spark), "_key").sortWithinPartitions("_key")
    listed = to_arrow_schema(StructType.fromDDL(LISTED))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(whole)
        out, done = None, []
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(batch.num_columns - 1)), 0
            rows = batch.select(range(batch.num_columns - 1))
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if out is None or out.key != key:
                    if out is not None:
                        done.append(out.close())
                    out = _File(system, root, key, rows.schema, group_bytes)
                out.add(rows.slice(start, end - start))
                start = end
            if len(done) >= _BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(done, listed)
                done = []
        if out is not None:
            yield pa.RecordBatch.from_pylist([*done, out.close()], listed)

    laid.mapInArrow(run, LISTED).write.option(_MARKED, "true").json(f"{path}/_files")
    system.create(spark._jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS"), True).close()


class _File:
    """The one file of a folder, written a row group at a time."""

    def __init__(self, system: fs.FileSystem, root: str, key: str, schema: pa.Schema, group_bytes: int):
        self.key, self.system, self.root, self.group_bytes = key, system, root, group_bytes
        self.keys = dict(zip(("subject", "run"), key.split("\x00")))
        folder = "/".join(f"{k}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', v)}" for k, v in self.keys.items())
        system.create_dir(f"{root}/{folder}", recursive=True)
        self.name, self.unfinished = f"{folder}/part-0.parquet", f"{root}/{folder}/_{uuid.uuid4().hex}"
        self.stream = system.open_output_stream(self.unfinished)
        self.writer = pq.ParquetWriter(self.stream, schema)
        self.held: list[pa.RecordBatch] = []
        self.bytes = self.groups = 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        self.bytes += rows.nbytes
        if self.bytes >= self.group_bytes:
            self._write_group()

    def _write_group(self) -> None:
        table = pa.Table.from_batches(self.held)
        self.writer.write_table(table, row_group_size=len(table))
        self.held, self.bytes, self.groups = [], 0, self.groups + 1

    def close(self) -> dict:
        if self.held:
            self._write_group()
        self.writer.close()
        self.stream.close()
        self.system.move(self.unfinished, f"{self.root}/{self.name}")
        return {"file": self.name, "parts": self.groups} | {k: None if v == _NOBODY else v for k, v in self.keys.items()}


def read(spark: SparkSession, path: str, schema: str, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the listed files that ``wanted``, a filter on subject and run, leaves; no other file is opened.

    Columns are found by name; those that a file does not have are null.
    """
    whole = _hadoop(spark, path)[1].toString()
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types = {f.name: f.dataType for f in StructType.fromDDL(schema)}
    listed = spark.read.schema(LISTED).json(f"{path}/_files", mode="FAILFAST")
    left = wanted(listed.select("file", *(F.col(k).cast(types[k]) for k in ("subject", "run")), "parts"))
    parts = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(whole)
        held, rows, size = [], 0, 0
        for batch in batches:
            for part in batch.to_pylist():
                for found in _rows(system, root, part, arrow):
                    held.append(found)
                    rows, size = rows + len(found), size + found.nbytes
                    if rows >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, rows, size = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return parts.repartition(_tasks(spark), "file", "part").mapInArrow(run, schema)


def _rows(system: fs.FileSystem, root: str, part: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Part ``part`` of ``parts`` equal runs of the row groups of a file."""
    with system.open_input_file(f"{root}/{part['file']}") as opened:
        file = pq.ParquetFile(opened)
        begin, end = (file.num_row_groups * k // part["parts"] for k in (part["part"], part["part"] + 1))
        for group in range(begin, end):
            known = file.metadata.row_group(group)
            step = max(1, min(_BATCH_ROWS, known.num_rows * _BATCH_BYTES // max(known.total_byte_size, 1)))
            for batch in file.iter_batches(step, row_groups=[group], use_threads=False):
                places = {name.lower(): k for k, name in enumerate(batch.schema.names)}
                columns = []
                for field in schema:
                    if field.name in ("subject", "run"):
                        columns.append(pa.repeat(pa.scalar(part[field.name], field.type), len(batch)))
                    elif field.name.lower() in places:
                        columns.append(batch.column(places[field.name.lower()]).cast(field.type))
                    else:
                        columns.append(pa.nulls(len(batch), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
