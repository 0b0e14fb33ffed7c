"""Binary recordings on a grid of subjects and runs, as a Spark source and sink.

A file ``S001/S001R03.edf`` is one recording in the European Data Format: an
ASCII header, then data records of equal size with 16-bit samples of each
signal, and a signal of time-stamped annotations (EDF+). The source has one
row per sample, or per annotation with ``content`` = ``annotations``.

A file is cut at data records into partitions of about ``partition_bytes``.
Filters on subject and run are pushed down to the list of files; header and
data records are read by byte range inside the tasks. Paths are those of any
file system that Arrow knows.

    recordings.scan(spark, path).where("subject = 3 AND run IN (3, 7)")
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillwave.session import settle

SAMPLES = "subject int, run int, t double, values array<double>"
ANNOTATIONS = "subject int, run int, onset double, duration double, code string"

# Field widths of the format, for the file and for each signal.
FILE_FIELDS = (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)
SIGNAL_FIELDS = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
NOTES_LABEL = "EDF Annotations"
LOWEST, HIGHEST = -32768, 32767

_NAME = re.compile(r"S(\d+)R(\d+)\.edf$")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Header:
    """What is needed to find and scale samples."""

    records: int
    seconds: float
    labels: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    sizes: tuple[int, ...]

    @property
    def bytes(self) -> int:
        return 256 * (len(self.labels) + 1)

    @property
    def record_bytes(self) -> int:
        return 2 * sum(self.sizes)

    def packed(self) -> bytes:
        n = len(self.labels)
        whole = ("0", "", "", "01.01.00", "00.00.00", str(self.bytes), "EDF+C", str(self.records), f"{self.seconds:.8g}", str(n))
        signals = (
            self.labels, [""] * n, [""] * n, [f"{v:.8g}"[:8] for v in self.low], [f"{v:.8g}"[:8] for v in self.high],
            [str(LOWEST)] * n, [str(HIGHEST)] * n, [""] * n, map(str, self.sizes), [""] * n,
        )
        text = "".join(v.ljust(w) for v, w in zip(whole, FILE_FIELDS))
        return (text + "".join(v.ljust(w) for column, w in zip(signals, SIGNAL_FIELDS) for v in column)).encode("ascii")

    @classmethod
    def parsed(cls, first: bytes, rest: bytes) -> Header:
        edges = np.cumsum((0, *FILE_FIELDS))
        whole = [first[a:b].decode("ascii").strip() for a, b in zip(edges, edges[1:])]
        n, columns, at = int(whole[9]), [], 0
        for width in SIGNAL_FIELDS:
            columns.append([rest[at + k * width : at + (k + 1) * width].decode("ascii").strip() for k in range(n)])
            at += n * width
        if any(int(v) != LOWEST for v in columns[5]) or any(int(v) != HIGHEST for v in columns[6]):
            low = [float(p) + (LOWEST - float(d)) * s for p, d, s in zip(columns[3], columns[5], cls._steps(columns))]
            high = [float(p) + (HIGHEST - float(d)) * s for p, d, s in zip(columns[4], columns[6], cls._steps(columns))]
        else:
            low, high = [float(v) for v in columns[3]], [float(v) for v in columns[4]]
        return cls(int(whole[7]), float(whole[8]), tuple(columns[0]), tuple(low), tuple(high), tuple(int(v) for v in columns[8]))

    @staticmethod
    def _steps(columns: list[list[str]]) -> list[float]:
        return [(float(b) - float(a)) / (float(d) - float(c)) for a, b, c, d in zip(*columns[3:7])]


def read_header(file: pa.NativeFile) -> Header:
    file.seek(0)
    first = file.read(256)
    if len(first) < 256:
        raise ValueError("not a recording, or cut off")
    return Header.parsed(first, file.read(256 * int(first[252:256])))


def samples_of(header: Header, data: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and scaled values (samples x channels) of whole data records."""
    channels = [k for k, label in enumerate(header.labels) if label != NOTES_LABEL]
    sizes = {header.sizes[k] for k in channels}
    if len(sizes) > 1:
        raise ValueError(f"signals of several rates: {sorted(sizes)} samples a record")
    size = sizes.pop() if sizes else 0
    rows = np.frombuffer(data, "<i2").reshape(-1, header.record_bytes // 2)
    edges = np.cumsum((0, *header.sizes))
    out = np.empty((len(rows) * size, len(channels)))
    for place, k in enumerate(channels):
        step = (header.high[k] - header.low[k]) / (HIGHEST - LOWEST)
        out[:, place] = (rows[:, edges[k] : edges[k + 1]].reshape(-1).astype(float) - LOWEST) * step + header.low[k]
    times = (first * size + np.arange(len(out))) * (header.seconds / size if size else 0)
    return np.round(times, 5), out


def notes_of(header: Header, data: bytes) -> Iterator[tuple[float, float, str]]:
    """Onset, duration and text of the annotations in whole data records."""
    edges = 2 * np.cumsum((0, *header.sizes))
    for record in range(len(data) // header.record_bytes):
        own = data[record * header.record_bytes : (record + 1) * header.record_bytes]
        for k, label in enumerate(header.labels):
            if label != NOTES_LABEL:
                continue
            for item in own[edges[k] : edges[k + 1]].split(b"\x00"):
                moment, *texts = item.split(b"\x14")
                onset, _, duration = moment.partition(b"\x15")
                for text in filter(None, texts):
                    yield float(onset), float(duration or 0), text.decode()


class RecordingSource(DataSource):
    """Options: ``path``, ``content`` (samples or annotations), ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return ANNOTATIONS if self.options.get("content", "samples") == "annotations" else SAMPLES

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


@dataclass
class Part(InputPartition):
    """Part ``number`` of ``parts`` equal runs of the data records of a file."""

    path: str
    subject: int
    run: int
    number: int
    parts: int


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.notes = options.get("content", "samples") == "annotations"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take equality and membership of subject and run; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column in ("subject", "run"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        """The files that are wanted, cut by size; no file is opened."""
        system, root = store(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            named = _NAME.search(info.base_name)
            if info.type != fs.FileType.File or not named:
                continue
            subject, run = map(int, named.groups())
            if subject in self.wanted.get("subject", {subject}) and run in self.wanted.get("run", {run}):
                parts = max(1, -(-info.size // self.partition_bytes))
                out += [Part(info.path, subject, run, k, parts) for k in range(parts)]
        return sorted(out, key=lambda p: (p.path, p.number))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.path)
        with system.open_input_file(part.path) as file:
            header = read_header(file)
            begin, end = (header.records * k // part.parts for k in (part.number, part.number + 1))
            # Some MB at a time, whole records.
            step = max(1, (4 << 20) // max(header.record_bytes, 1))
            for first in range(begin, end, step):
                count = min(step, end - first)
                file.seek(header.bytes + first * header.record_bytes)
                data = file.read(count * header.record_bytes)
                if len(data) < count * header.record_bytes:
                    raise ValueError(f"{part.path} is cut off")
                yield self._batch(part, header, data, first)

    def _batch(self, part: Part, header: Header, data: bytes, first: int) -> pa.RecordBatch:
        if self.notes:
            rows = list(notes_of(header, data))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string()))]
            names = ["onset", "duration", "code"]
        else:
            times, values = samples_of(header, data, first)
            offsets = np.arange(len(times) + 1, dtype=np.int32) * values.shape[1]
            columns = [pa.array(times), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))]
            names = ["t", "values"]
        keys = [pa.array(np.full(len(columns[0]), v, np.int32)) for v in (part.subject, part.run)]
        return pa.RecordBatch.from_arrays([*keys, *columns], ["subject", "run", *names])


def scan(spark: SparkSession, path: str, content: str = "samples", partition_bytes: int = 64 << 20) -> DataFrame:
    """Samples or annotations of all recordings below ``path``.

    Turns on the session's setting that hands filters to sources written in Python.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recordings").options(content=content, partition_bytes=partition_bytes).load(path)


def write_recordings(samples: DataFrame, notes: DataFrame, path: str, rate: int, low: float, high: float, note_bytes: int = 240) -> DataFrame:
    """Write (subject, run, place, values) and (subject, run, onset, duration, code) as one file per recording.

    ``place`` numbers the samples of a recording from 0. A data record is one
    second: ``rate`` samples of each channel and the annotations that begin in
    it. The last second is filled with zeros. Values are rounded to 65,536
    steps between ``low`` and ``high``. The seconds of a recording pass
    through one task one by one, as a file has one writer. Rows without a
    subject or run belong to no recording. Returns (path, subject, run, seconds).
    """
    second = F.floor(F.col("place") / rate)
    named = samples.where("subject IS NOT NULL AND run IS NOT NULL")
    moments = named.groupBy("subject", "run", second.alias("second")).agg(
        F.sort_array(F.collect_list(F.struct("place", "values"))).alias("samples"), F.max(F.size("values")).alias("channels")
    )
    own = notes.groupBy("subject", "run", F.floor("onset").alias("second")).agg(F.sort_array(F.collect_list(F.struct("onset", "duration", "code"))).alias("notes"))
    joined = moments.join(own, ["subject", "run", "second"], "left")
    # Windows keep a recording in one task. A join to its length would not:
    # adaptive execution may broadcast that and read the rows where they lie.
    whole = Window.partitionBy("subject", "run").orderBy("second").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = joined.select(
        "subject", "run", "second", "samples", "notes", (F.max("second").over(whole) + 1).alias("seconds"), F.max("channels").over(whole).alias("width")
    )
    picked = sized.sortWithinPartitions("subject", "run", "second")
    schema = "path string, subject int, run int, seconds bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, header, at, done = None, None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["subject"], row["run"]) != name:
                    if out:
                        _finish(out, header, at)
                    name, at = (row["subject"], row["run"]), 0
                    header = Header(
                        row["seconds"], 1.0, (*(f"C{k}" for k in range(row["width"])), NOTES_LABEL),
                        (low,) * row["width"] + (-1.0,), (high,) * row["width"] + (1.0,), (rate,) * row["width"] + (note_bytes // 2,),
                    )
                    file = f"{path}/S{name[0]:03d}/S{name[0]:03d}R{name[1]:02d}.edf"
                    system, inner = store(file)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner)
                    out.write(header.packed())
                    done.append((file, *name, row["seconds"]))
                for missing in range(at, row["second"]):
                    out.write(_record(header, [], [], missing, rate, low, high, note_bytes))
                out.write(_record(header, row["samples"], row["notes"] or [], row["second"], rate, low, high, note_bytes))
                at = row["second"] + 1
        if out:
            _finish(out, header, at)
            columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "subject", "run", "seconds"])

    return settle(picked.mapInArrow(run, schema))


def _finish(out: pa.NativeFile, header: Header, at: int) -> None:
    if at != header.records:
        raise ValueError(f"{at} records of {header.records} written")
    out.close()


def _record(header: Header, samples: list, notes: list, second: int, rate: int, low: float, high: float, note_bytes: int) -> bytes:
    """One second: the samples of each channel, then the annotations."""
    held = np.zeros((rate, len(header.labels) - 1))
    for sample in samples:
        held[sample["place"] - second * rate, : len(sample["values"])] = sample["values"]
    step = (high - low) / (HIGHEST - LOWEST)
    digits = np.clip(np.rint((held - low) / step) + LOWEST, LOWEST, HIGHEST).astype("<i2")
    lists = [f"+{second}\x14\x14\x00"] + [f"+{n['onset']:g}\x15{n['duration']:g}\x14{n['code']}\x14\x00" for n in notes]
    text = "".join(lists).encode()
    if len(text) > note_bytes:
        raise ValueError(f"annotations of second {second} take {len(text)} bytes, more than {note_bytes}")
    return digits.T.tobytes() + struct.pack(f"{note_bytes}s", text)
