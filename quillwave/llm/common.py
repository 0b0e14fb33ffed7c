"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillwave.session import scratch_path

# Words are runs of anything but these six bytes. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

# Lower-cases A-Z in UTF-8 bytes and leaves all other bytes alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives Spark the true size
    for choosing joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[list]], schema: str) -> DataFrame:
    """Run ``function`` on each Arrow batch; it yields the columns of result rows, as lists or arrays."""
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks build millions of small objects and no cycles.
        gc.disable()
        try:
            for batch in batches:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)],
                        schema=arrow,
                    )
                # Workers are used again; what Arrow holds in reserve counts as theirs.
                pa.default_memory_pool().release_unused()
        finally:
            gc.enable()

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """A read-only object (a parsed vocabulary) that later tasks of the same Python worker use again.

    Only one object per first part of the key is kept.
    """
    held = sys.modules.setdefault("_quillwave_kept", types.ModuleType("_quillwave_kept")).__dict__
    if held.get(key[0], (None,))[0] != key:
        held[key[0]] = (key, make())
    return held[key[0]][1]


def slices(texts: pa.Array, size: int) -> Iterator[range]:
    """Cut the rows of a batch into runs of about ``size`` bytes; no text is cut."""
    begin = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size:
            yield range(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenate the runs ``flat[starts[c] : starts[c] + counts[c]]`` of all codes."""
    sizes = counts[codes]
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    # Half the memory where 32 bits do.
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts[codes] - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts at blanks: part numbers of all texts, where each text's begin (with the end), distinct parts."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy()
    return coded.indices.to_numpy().copy(), bounds - bounds[0], coded.dictionary


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style path and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def replacing(path: str) -> Iterator[pa.NativeFile]:
    """Write a file under a name of its own and rename it when complete.

    A task that runs again, or twice at once, replaces the file as a whole.
    """
    system, name = store(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        yield out
    system.move(own, name)
