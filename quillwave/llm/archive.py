"""WARC records in ZIP-packaged web archives (WACZ), written and range-read.

Each partition of pages becomes one archive: ``archive/data.warc.gz`` (a gzip
member per record) and ``indexes/index.cdx`` (a JSON index line per record),
both stored in the ZIP without compression. The reader takes the end of the
file, its central directory and, where present, the ZIP64 records, locates the
stored members, reads the index, and then reads each record by its byte range;
nothing is unpacked.

Defined results: null html counts as empty. A null page_id is always a response
and nothing refers to it. Rows that share the smallest id of a payload are all
responses. No rows: no archives and no result rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema, on_batches, replacing, store, written
from quillwave.session import scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:quillwave:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record; a revisit holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_NAME}{'' if page_id is None else page_id}>",
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{_NAME}{refers_to}>", "WARC-Profile": _PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record: page_id, url, type, refers_to, payload_bytes, digest, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda text: int(n) if (n := text.strip("<>").removeprefix(_NAME)) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": size,
        "digest": digest,
        "payload": None if revisit else payload,
    }


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipIndex:
    """The directory of a ZIP file that is read by byte ranges."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        tail = self.range(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, begin = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
            (wide,) = struct.unpack_from("<Q", tail, at - 12)
            end = self.range(wide, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("broken ZIP64 directory")
            count, length, begin = struct.unpack_from("<QQQ", end, 32)
        self.members = {m.name: m for m in self._entries(self.range(begin, length), count)}

    def range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("broken ZIP directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end = at + 46 + name_size, at + 46 + name_size + extra_size
            while extra + 4 <= end:
                kind, length = struct.unpack_from("<HH", raw, extra)
                if kind == 1:
                    # ZIP64: one 8-byte value for each field that is all ones, in this order.
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, extra + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra += 4 + length
            yield Member(name, method, size, packed, header)
            at = end + note_size

    def start(self, name: str) -> int:
        """The first byte of a stored member's content."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed; its parts can't be read by range")
        name_size, extra_size = struct.unpack_from("<HH", self.range(member.header, 30), 26)
        return member.header + 30 + name_size + extra_size

    def read(self, name: str) -> bytes:
        return self.range(self.start(name), self.members[name].size)


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def referring(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, first): pages whose payload of ``least`` bytes or more has a smaller id elsewhere."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= least)).select("page_id", F.sha2(html, 256).alias("digest"))
    several = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = written(several.select("digest", "first"), "payloads")
    # Ids of one row each are narrow; the pages themselves are not dealt by digest.
    return written(known.join(several, "digest").where("page_id <> first").select("page_id", "first").distinct(), "revisits")


def write(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; returns the archives (path, n_records, n_bytes)."""
    html = F.coalesce("html", F.lit(""))
    rows = (
        pages.select("page_id", "url", html.alias("html"))
        .join(referring(pages, least), "page_id", "left")
        .select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), "first")
    )
    schema = "path string, n_records bigint, n_bytes bigint"
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, lines, at = f"{folder}/pages-{TaskContext.get().partitionId():06d}.wacz", [], 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with replacing(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                batch = first
                while batch is not None:
                    for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                        packed = _gzip(record(page_id, url, payload, digest, refers_to, date))
                        data.write(packed)
                        place = {"url": url, "page_id": page_id, "digest": digest, "offset": at, "length": len(packed)}
                        lines.append(f"{page_id} {date} {json.dumps(place)}")
                        at += len(packed)
                    batch = next(batches, None)
            archive.writestr(INDEX, "\n".join(lines))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(lines)]), pa.array([at])], schema=arrow)

    return written(rows.mapInArrow(run, schema), "archives")


def read(archives: DataFrame, slice_bytes: int = 4_000_000) -> DataFrame:
    """Read archives back: a row per record with its payload (null for revisits).

    The first step reads directories and indexes and cuts each archive into byte
    ranges, which are then dealt out, so a large archive is read by many tasks.
    """

    def locate(batch: pa.RecordBatch) -> Iterator[list]:
        for path in batch.column(0).to_pylist():
            system, name = store(path)
            with system.open_input_file(name) as file:
                index = ZipIndex(file)
                base = index.start(DATA)
                out: list[list] = [[], [], []]
                for line in index.read(INDEX).decode().split("\n"):
                    place = json.loads(line.split(" ", 2)[2])
                    if not out[0] or sum(out[2][-1]) + place["length"] > slice_bytes:
                        for column, value in zip(out, (path, base + place["offset"], [])):
                            column.append(value)
                    out[2][-1].append(place["length"])
            yield out

    def fetch(batch: pa.RecordBatch) -> Iterator[list]:
        for path, at, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = store(path)
            out: list[list] = [[] for _ in range(7)]
            with system.open_input_file(name) as file:
                file.seek(at)
                for size in sizes:
                    for column, value in zip(out, parse(zlib.decompress(file.read(size), 31)).values()):
                        column.append(value)
            yield out

    files = max(1, archives.count())
    ranges = on_batches(archives.select("path").repartition(files, "path"), locate, "path string, at bigint, sizes array<bigint>")
    return on_batches(
        ranges.repartition(4 * files, "path", "at"),
        fetch,
        "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary",
    )


def write_and_read(pages: DataFrame, spark: SparkSession) -> DataFrame:
    return read(write(pages, scratch_path(spark, "wacz")))
