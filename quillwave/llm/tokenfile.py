"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of documents in ascending id order:

    magic
    blocks      per block: count, minimum, width, number of exceptions;
                packed low bits; exception positions; exception high bits
    block index start byte and first position of each block
    doc index   doc id, number of ids, presence of the doc id
    footer      numbers of blocks and documents, start of the index, magic

A block subtracts its minimum and packs the rest at the width that covers a
chosen percentile of its values; the others are exceptions whose missing high
bits are stored in a list. A reader finds any position by the block index.

Defined results: null text counts as empty and still gets the end id. Null ids
come first. Repeated rows are repeated documents, ordered by text. No rows: no
files and no result rows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema, kept_in_worker, pieces_of, ragged, replacing, slices, store, written
from quillwave.session import scratch_path

_MAGIC = b"QWIDS01\n"
_HEAD, _HEAD_SIZE = "<IIHH", struct.calcsize("<IIHH")
_FOOT, _FOOT_SIZE = "<QQQ8s", struct.calcsize("<QQQ8s")
_SLICE = 24_000_000
# Characters that the tokenizer gets at once; its own results are large.
_RUN = 200_000
# A blank starts a new piece of a byte-level vocabulary only before a visible
# character. Texts with other blanks, or special tokens, are encoded whole.
_ODD = (
    r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $|<\|"
)


# Letters up to U+024F: runs of them, and one mark after them, are pieces of
# their own in every byte-level vocabulary with the usual pattern.
_LETTERS = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
_WORD, _MARKED = f"^{_LETTERS}$", f"^{_LETTERS}[.,!]$"
# A sentence end, a line feed and the next word, with or without a mark.
_DOTTED = rf"^(?P<left>{_LETTERS})\.\n(?P<right>{_LETTERS})(?P<mark>[.,]?)$"
_MARKS = [".", ",", "!", "\n", ""]


def _runs(texts: list[str]) -> Iterator[list[str]]:
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _RUN:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    yield texts[begin:]


def _codes(texts: pa.Array, known: list[str]) -> np.ndarray:
    """Positions in ``known``."""
    return pc.index_in(texts, value_set=pa.array(known, pa.string())).to_numpy(zero_copy_only=False).astype(np.int32)


class ByteCoder:
    """Ids of whole texts; each distinct word of a slice goes through the tokenizer once."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.odd = "|".join([_ODD, *map(re.escape, self.special)])
        names = self.library.get_vocab()
        # Ids whose bytes begin with a blank.
        self.blank = np.zeros(max(names.values()) + 1, bool)
        self.blank[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts encoded one by one, and their numbers."""
        flat, counts = [], []
        for run in _runs(texts):
            coded = [e.ids for e in self.library.encode_batch_fast(run, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, coded), np.int32, len(coded)))
            flat.append(np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(counts[-1].sum())))
        return np.concatenate(flat), np.concatenate(counts)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a blank before each, and their numbers.

        Many words are one text for the tokenizer. The blank starts a new
        piece, and no other id of a word begins with one.
        """
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for run in _runs(words):
            if run:
                (coded,) = self.library.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)
                flat.append(np.array(coded.ids, np.uint32))
                counts.append(np.diff(np.flatnonzero(self.blank[flat[-1]]), append=len(flat[-1])).astype(np.int32))
        return np.concatenate(flat), np.concatenate(counts)

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts between blanks, each with the blank before it, and their numbers.

        Parts are cut where that can't change their ids: words, words with a
        mark, and words around a sentence end and a line feed.
        """
        word, marked, dotted = (
            pc.match_substring_regex(parts, p).to_numpy(zero_copy_only=False) for p in (_WORD, _MARKED, _DOTTED)
        )
        rest = parts.filter(pa.array(~(word | marked | dotted))).to_pylist()
        with_mark = parts.filter(pa.array(marked))
        around = pc.extract_regex(parts.filter(pa.array(dotted)), _DOTTED)
        left, right, mark = (pc.struct_field(around, k) for k in range(3))
        lefts = pa.concat_arrays([parts.filter(pa.array(word)), pc.utf8_slice_codeunits(with_mark, 0, -1), left]).dictionary_encode()
        rights = right.dictionary_encode()
        flat, sizes = self._word_ids(lefts.dictionary.to_pylist())
        n_words = len(sizes)
        more, more_sizes = self._ids([*_MARKS, *rights.dictionary.to_pylist(), *(f" {p}" for p in rest)])
        flat, sizes = np.append(flat, more), np.append(sizes, more_sizes)
        # Codes of the cuts of each part, in order.
        held = np.ones(len(parts), np.int32)
        held[marked], held[dotted] = 2, 5
        start = np.cumsum(held, dtype=np.int64) - held
        inner = np.zeros(int(held.sum()), np.int32)
        begin, end = int(word.sum()), int(word.sum() + marked.sum())
        codes = lefts.indices.to_numpy()
        for kind, own in ((word, codes[:begin]), (marked, codes[begin:end]), (dotted, codes[end:])):
            inner[start[kind]] = own
        inner[start[marked] + 1] = n_words + _codes(pc.utf8_slice_codeunits(with_mark, -1, 2**31 - 1), _MARKS)
        at = start[dotted]
        inner[at + 1], inner[at + 2] = n_words, n_words + 3
        inner[at + 3] = n_words + len(_MARKS) + rights.indices.to_numpy()
        inner[at + 4] = n_words + _codes(mark, _MARKS)
        inner[start[~(word | marked | dotted)]] = n_words + len(_MARKS) + len(rights.dictionary) + np.arange(len(rest))
        counts = np.add.reduceat(sizes[inner], start) if len(parts) else np.zeros(0, np.int32)
        return ragged(flat, np.cumsum(sizes, dtype=np.int64) - sizes, sizes, inner), counts

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end`` after each, and where each text's ids begin (with the end)."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        codes, bounds, parts = pieces_of(pc.if_else(pa.array(odd), "", texts))
        leading, place = np.unique(codes[bounds[:-1]], return_inverse=True)
        whole = texts.filter(pa.array(odd)).to_pylist()
        flat, counts = self._part_ids(parts)
        # The first part of a text has no blank before it.
        more, more_counts = self._ids(parts.take(pa.array(leading)).to_pylist() + whole)
        flat, counts = np.append(flat, more), np.append(counts, more_counts)
        place = place + len(parts)
        place[odd] = len(parts) + len(leading) + np.arange(len(whole))
        codes[bounds[:-1]] = place
        # One more code, the end id, after the parts of each text.
        flat, counts = np.append(flat, np.uint32(end)), np.append(counts, np.int32(1))
        codes = np.insert(codes, bounds[1:], len(counts) - 1)
        starts = np.cumsum(counts, dtype=np.int64) - counts
        bounds = bounds + np.arange(len(bounds))
        return ragged(flat, starts, counts, codes), np.append(0, np.cumsum(counts[codes], dtype=np.int64))[bounds]


def coder_of(docs: DataFrame, tokenizer: str):
    """A function that gives the tasks their coder; the file is read by the driver."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    return lambda: kept_in_worker(("bytes", tokenizer), lambda: ByteCoder(spec.value))


def pack_block(values: np.ndarray, percentile: float) -> bytes:
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(percentile * len(rest))))[k]).bit_length()
    patched = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return b"".join(
        (
            struct.pack(_HEAD, len(values), low, width, len(patched)),
            np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),
            patched.astype("<u2").tobytes(),
            (rest[patched] >> np.uint32(width)).astype("<u4").tobytes() if width < 32 else b"",
        )
    )


def unpack_block(data: bytes) -> np.ndarray:
    count, low, width, patches = struct.unpack_from(_HEAD, data)
    size = (count * width + 7) // 8
    packed = np.frombuffer(data, np.uint8, size, _HEAD_SIZE)
    bits = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
    values = (bits * (1 << np.arange(width, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    at = np.frombuffer(data, "<u2", patches, _HEAD_SIZE + size)
    high = np.frombuffer(data, "<u4", patches, _HEAD_SIZE + size + 2 * patches)
    values[at] |= high.astype(np.uint64) << np.uint64(width)
    return (values + np.uint64(low)).astype(np.uint32)


class FileWriter:
    """Writes the blocks of one file as ids come in."""

    def __init__(self, out, block: int, percentile: float):
        self.out, self.block, self.percentile = out, block, percentile
        self.starts, self.at, self.position = [], len(_MAGIC), 0
        self.docs: list[tuple[list, np.ndarray]] = []
        self.open = np.zeros(0, np.uint32)
        out.write(_MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.docs.append((doc_ids, np.diff(bounds)))
        held = np.concatenate([self.open, ids]) if len(self.open) else ids
        full = len(held) // self.block * self.block
        for begin in range(0, full, self.block):
            self._write(held[begin : begin + self.block])
        self.open = held[full:].copy()

    def _write(self, values: np.ndarray) -> None:
        data = pack_block(values, self.percentile)
        self.starts.append((self.at, self.position))
        self.out.write(data)
        self.at += len(data)
        self.position += len(values)

    def close(self) -> None:
        if len(self.open):
            self._write(self.open)
        names = [i for ids, _ in self.docs for i in ids]
        counts = np.concatenate([c for _, c in self.docs]) if self.docs else np.zeros(0, np.int64)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([0 if i is None else i for i in names], "<i8").tobytes())
        self.out.write(counts.astype("<u8").tobytes())
        self.out.write(np.array([i is not None for i in names], np.uint8).tobytes())
        self.out.write(struct.pack(_FOOT, len(self.starts), len(names), self.at, _MAGIC))


class FileReader:
    """Reads documents of one file, a block at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        blocks, docs, at, magic = struct.unpack(_FOOT, self._range(size - _FOOT_SIZE, _FOOT_SIZE))
        if magic != _MAGIC:
            raise ValueError("not a token file, or cut off")
        index = self._range(at, size - _FOOT_SIZE - at)
        self.starts = np.frombuffer(index, "<u8", 2 * blocks).reshape(blocks, 2).astype(np.int64)
        self.ends = np.append(self.starts[1:, 0], at)
        names = np.frombuffer(index, "<i8", docs, 16 * blocks)
        there = np.frombuffer(index, np.uint8, docs, 16 * blocks + 16 * docs)
        self.doc_ids = [i if k else None for i, k in zip(names.tolist(), there.tolist())]
        self.counts = np.frombuffer(index, "<u8", docs, 16 * blocks + 8 * docs).astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, number: int) -> np.ndarray:
        begin = int(self.starts[number, 0])
        return unpack_block(self._range(begin, int(self.ends[number]) - begin))

    def doc(self, number: int) -> np.ndarray:
        """The ids of one document, found by the block index."""
        begin, count = int(self.begins[number]), int(self.counts[number])
        first = int(np.searchsorted(self.starts[:, 1], begin, "right")) - 1
        held = []
        while count > 0:
            values = self.block(first)[begin - int(self.starts[first, 1]) :][:count]
            held.append(values)
            begin, count, first = begin + len(values), count - len(values), first + 1
        return np.concatenate(held) if held else np.zeros(0, np.uint32)

    def __iter__(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """All documents in order: id, first position in the file, ids."""
        held, base, number = np.zeros(0, np.uint32), 0, 0
        for name, begin, count in zip(self.doc_ids, self.begins.tolist(), self.counts.tolist()):
            parts, have = [held[begin - base :]], len(held) - (begin - base)
            while have < count:
                parts.append(self.block(number))
                have, number = have + len(parts[-1]), number + 1
            held, base = np.concatenate(parts) if len(parts) > 1 else parts[0], begin
            yield name, begin, held[:count]


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end: int = 2,
    block: int = 8192,
    percentile: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents; returns the files (file, path, n_docs, n_tokens).

    Documents are range partitioned by id, each partition is one file. ``block``
    is at most 65,536.
    """
    coder = coder_of(docs, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        path = f"{folder}/ids-{number:06d}.bin"
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        with replacing(path) as out:
            file = FileWriter(out, block, percentile)
            for batch in itertools.chain([first], batches):
                texts = batch.column(1).cast(pa.string()).fill_null("")
                for rows in slices(texts, _SLICE):
                    ids, bounds = coder().encode(texts[rows.start : rows.stop], end)
                    file.add(batch.column(0)[rows.start : rows.stop].to_pylist(), ids, bounds)
            file.close()
        row = [[number], [path], [sum(len(i) for i, _ in file.docs)], [file.position]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)

    schema = "file int, path string, n_docs bigint, n_tokens bigint"
    arrow = arrow_schema(schema)
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id", "_text")
    )
    return written(ordered.mapInArrow(run, schema), "token-files")


def read(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read token files back: (id, start, ids); ``start`` counts the ids of all files before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = store(path)
                with system.open_input_file(name) as file:
                    docs = iter(FileReader(file))
                    while some := list(itertools.islice(docs, 500)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([d[0] for d in some], pa.int64()),
                                pa.array([before + d[1] for d in some], pa.int64()),
                                pa.array([len(d[2]) for d in some], pa.int64()),
                                pa.array([d[2].astype("<u4").tobytes() for d in some], pa.binary()),
                            ],
                            schema=arrow,
                        )

    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids binary"
    arrow = arrow_schema(schema)
    # One row per file; the running sum over them is small.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_before"))
    return placed.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, spark: SparkSession) -> DataFrame:
    """Write to a new folder below the shared one and read back."""
    return read(write(docs, scratch_path(spark, "ids"), tokenizer))


def digests(tokens: DataFrame) -> DataFrame:
    """Unsigned CRC-32 of the ids, as little-endian 32-bit integers."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
