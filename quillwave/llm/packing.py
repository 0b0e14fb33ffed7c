"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens; only longer ones
are cut, and then only the first piece may be shorter. Full pieces are
sequences of their own. The others are packed by best-fit decreasing inside
partitions of bounded size. Dual feasible functions give each partition a lower
bound on its number of sequences; a partition that meets it is certified.
Partitions with a gap exchange the documents of all sequences that are not full
and run again; a certified partition hands on only its emptiest sequence. The
number of partitions follows the number of pieces that go on, so a partition
never grows. The rounds end when one partition is left, when a round hands on
nearly all that it got, or after ``max_rounds``; the last one settles all.

Defined results: null text counts as empty and is one piece with the end id.
Null ids are ids like any other. Repeated rows are packed once each. Extra
columns are not read. A text of any length is encoded whole. No rows give no
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema, on_batches, slices, written
from quillwave.llm.tokenfile import coder_of

_SLICE = 12_000_000
_BIN_BITS = 24


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document."""
    first = tokens if tokens <= capacity else tokens % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode and cut: (id, piece, start, length, ids_crc32[, ids])."""
    coder = coder_of(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        texts, names = batch.column(1).cast(pa.string()).fill_null(""), batch.column(0).to_pylist()
        for rows in slices(texts, _SLICE):
            ids, bounds = coder().encode(texts[rows.start : rows.stop], end)
            ids, bounds = ids.astype("<u4"), bounds.tolist()
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for i, begin, stop in zip(rows, bounds, bounds[1:]):
                for number, (start, length) in enumerate(cut_points(stop - begin, capacity)):
                    raw = ids[begin + start : begin + start + length].tobytes()
                    row = (names[i], number, start, length, zlib.crc32(raw), raw)
                    for column, value in zip(out, row):
                        column.append(value)
            yield out

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(picked.dtypes)['_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    out = on_batches(picked, run, schema + (", ids binary" if with_ids else ""))
    return out.withColumnRenamed("_id", id_col)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence and offset of each piece, and what each sequence holds.

    Open sequences are kept by free space, and a bit set of the spaces that
    occur finds the tightest one in a few integer operations.
    """
    where, offset, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            place = open_by_space[space].pop()
            if not open_by_space[space]:
                spaces ^= 1 << space
        else:
            space, place = capacity, len(held)
            held.append(0)
        where[i], offset[i] = place, capacity - space
        held[place] += size
        if space > size:
            open_by_space[space - size].append(place)
            spaces |= 1 << (space - size)
    return where, offset, np.array(held, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions.

    A function u with sum u(x) <= 1 for every set of sizes that fits bounds the
    number of sequences by sum u(size). The first family drops small sizes
    below a threshold and rounds sizes that leave less than it up to a whole
    sequence. The second rounds sizes to multiples of 1 / k.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    weights = counts * size
    below = np.append(0, np.cumsum(weights))
    above = np.append(0, np.cumsum(counts[::-1]))[::-1]
    t = np.arange(capacity // 2 + 1)
    # Sizes over capacity - t count whole, sizes t .. capacity - t as they are.
    total = above[capacity - t + 1] * capacity + below[capacity - t + 1] - below[t]
    best = int((-(-total // capacity)).max())
    for k in range(1, 64):
        scaled, exact = size * (k + 1) // capacity, size * (k + 1) % capacity == 0
        # In units of 1 / (k * capacity).
        value = np.where(exact, size * k, scaled * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def _packer(columns: list[str], arrow: pa.Schema, capacity: int, number: int, final: bool) -> Callable[[pa.Table], pa.Table]:
    """The packing of one group in round ``number``; in the final round every sequence is settled."""

    def pack(group: pa.Table) -> pa.Table:
        sizes = group.column("length").to_numpy().astype(np.int64)
        where, offset, held = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        settled = held == capacity
        if final:
            settled[:] = True
        elif len(held) == bound:
            emptiest = int(held.argmin())
            settled[:] = True
            settled[emptiest] = held[emptiest] == capacity
        name = group.column("_group")[0].as_py()
        base = ((number << 32) + name) << _BIN_BITS
        extra = [
            pa.array(base + where),
            pa.array(offset),
            pa.array(settled[where]),
            *(pa.array(np.full(len(sizes), v)) for v in (name, len(held), bound)),
        ]
        kept = [group.column(c) for c in columns]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip([*kept, *extra], arrow)], schema=arrow)

    return pack


def place(
    items: DataFrame, capacity: int = 1024, per_group: int = 20_000, max_rounds: int = 8, least_gain: float = 0.1
) -> tuple[DataFrame, list[DataFrame]]:
    """Add ``sequence_id`` and ``offset`` to rows that have ``length``.

    Also returns per round the certificates: (group_no, pieces, sequences, bound).
    ``items`` must be a written table. Every piece is placed, whatever ends the
    rounds: one group left, less than ``least_gain`` of the pieces settled by
    the round before, or ``max_rounds``.
    """
    columns = items.columns
    done = items.where(F.col("length") >= capacity).select(
        *columns, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    left, certificates = items.where(F.col("length") < capacity), []
    schema = left.schema
    result_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, sequence_id bigint, offset bigint, _settled boolean, group_no bigint, sequences bigint, bound bigint"
    arrow = arrow_schema(result_schema)
    before = None
    for number in range(max_rounds):
        count = left.count()
        if not count:
            break
        groups = -(-count // per_group)
        stuck = before is not None and count > (1 - least_gain) * before
        final = groups == 1 or stuck or number == max_rounds - 1
        before = count

        # Row numbers of a written table spread any ids evenly.
        spread = left.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))
        packed = written(spread.groupBy("_group").applyInArrow(_packer(columns, arrow, capacity, number, final), result_schema), "packed")
        certificates.append(
            packed.groupBy("group_no").agg(
                F.count(F.lit(1)).alias("pieces"), F.first("sequences").alias("sequences"), F.first("bound").alias("bound")
            )
        )
        done = done.unionByName(packed.where("_settled").select(*columns, "sequence_id", "offset"))
        left = packed.where("NOT _settled").select(*columns)
        if final:
            break
    return done, certificates


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and place all documents: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = written(pieces(docs, tokenizer, capacity, end, id_col, text_col), "pieces")
    return place(cut, capacity)[0]
