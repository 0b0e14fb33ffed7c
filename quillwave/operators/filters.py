"""Zero-phase recursive filters on series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.session import settle


# Samples that one matrix product takes.
BLOCK = 32


class Recursion:
    """Difference equation with coefficients ``b`` over ``a``.

    ``memory`` is its state between two samples. It changes linearly: after n
    samples it is ``step ** n @ memory`` plus what the samples alone leave.
    """

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        width = max(len(a), len(b), 2)
        self.b = np.pad(np.asarray(b, dtype=float), (0, width - len(b))) / a[0]
        self.a = np.pad(np.asarray(a, dtype=float), (0, width - len(a))) / a[0]
        self.step = np.zeros((width - 1, width - 1))
        self.step[:, 0] = -self.a[1:]
        self.step[:-1, 1:] += np.eye(width - 2)
        # Memory after an endless input of ones.
        self.steady = np.linalg.solve(np.eye(width - 1) - self.step, self.b[1:] - self.a[1:] * self.b[0])
        self.default_pad = 3 * width
        self._blocks()

    def _blocks(self) -> None:
        """Matrices that take ``BLOCK`` samples at once.

        Outputs are ``x @ inner + memory @ seen``; the memory after the block
        is ``x @ kept + memory @ after``.
        """
        order = len(self.steady)
        memories = [np.eye(order)]
        for _ in range(BLOCK):
            memories.append(self.step @ memories[-1])
        self.seen = np.stack([m[0] for m in memories[:-1]], axis=1)
        enters = self.b[1:] - self.a[1:] * self.b[0]
        response = np.concatenate([[self.b[0]], [(m @ enters)[0] for m in memories[: BLOCK - 1]]])
        self.inner = np.zeros((BLOCK, BLOCK))
        for t in range(BLOCK):
            self.inner[t, t:] = response[: BLOCK - t]
        self.kept = np.stack([memories[BLOCK - 1 - t] @ enters for t in range(BLOCK)])
        self.after = memories[BLOCK].T

    def run(self, rows: list[np.ndarray], memory: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Filter many rows together: whole blocks by matrix products, then the rest sample by sample.

        Returns the filtered rows and the memory that each one leaves.
        """
        blocks = np.array([len(row) // BLOCK for row in rows], int)
        state, out = np.array(memory, float).reshape(len(rows), len(self.steady)), [np.array(row, float) for row in rows]
        most_first = np.argsort(-blocks, kind="stable")
        for k in range(blocks.max(initial=0)):
            own = most_first[: np.searchsorted(-blocks[most_first], -k)]
            x = np.stack([out[i][k * BLOCK : (k + 1) * BLOCK] for i in own])
            y = x @ self.inner + state[own] @ self.seen
            state[own] = x @ self.kept + state[own] @ self.after
            for i, done in zip(own, y):
                out[i][k * BLOCK : (k + 1) * BLOCK] = done
        rest, left = self._steps([row[n * BLOCK :] for row, n in zip(rows, blocks)], state)
        for i, (n, done) in enumerate(zip(blocks, rest)):
            out[i][n * BLOCK :] = done
        return out, left

    def _steps(self, rows: list[np.ndarray], memory: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """One time step after the other, all rows together."""
        lengths = np.array([len(row) for row in rows], int)
        longest_first = np.argsort(-lengths, kind="stable")
        x = np.zeros((len(rows), lengths.max(initial=0)))
        for place, k in enumerate(longest_first):
            x[place, : lengths[k]] = rows[k]
        y = np.empty_like(x)
        state = np.zeros((len(rows), len(self.steady) + 1))
        state[:, :-1] = memory[longest_first]
        active = np.searchsorted(-lengths[longest_first], -np.arange(x.shape[1]))
        for t, n in enumerate(active):
            now = x[:n, t]
            y[:n, t] = self.b[0] * now + state[:n, 0]
            state[:n, :-1] = state[:n, 1:] + np.outer(now, self.b[1:]) - np.outer(y[:n, t], self.a[1:])
        out: list[np.ndarray] = [np.empty(0)] * len(rows)
        left = np.empty((len(rows), len(self.steady)))
        for place, k in enumerate(longest_first):
            out[k] = y[place, : lengths[k]]
            left[k] = state[place, :-1]
        return out, left

    def skip(self, memory: np.ndarray, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.step, n) @ memory


class Cascade:
    """Second-order sections ``(b, a)`` one after another; the memory is that of all sections.

    A filter of high order keeps its accuracy this way, which one pair of long
    coefficient lists doesn't.
    """

    def __init__(self, sections: Sequence[tuple[Sequence[float], Sequence[float]]]):
        self.sections = [Recursion(b, a) for b, a in sections]
        self.widths = np.cumsum([0, *(len(s.steady) for s in self.sections)])
        # Each section's steady input is what the ones before it make of ones.
        gains = np.cumprod([1.0, *(s.b.sum() / s.a.sum() for s in self.sections)])
        self.steady = np.concatenate([gain * s.steady for gain, s in zip(gains, self.sections)])
        self.default_pad = sum(s.default_pad for s in self.sections)
        # One sample of silence, from every unit memory.
        _, left = self.run([np.zeros(1)] * len(self.steady), np.eye(len(self.steady)))
        self.step = left.T

    def run(self, rows: list[np.ndarray], memory: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        memory = np.asarray(memory, float).reshape(len(rows), len(self.steady))
        left = np.empty_like(memory)
        for section, begin, end in zip(self.sections, self.widths, self.widths[1:]):
            rows, left[:, begin:end] = section.run(rows, memory[:, begin:end])
        return rows, left

    def skip(self, memory: np.ndarray, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.step, n) @ memory


def _rule(b, a) -> Recursion | Cascade:
    """The filter of coefficients ``b`` over ``a``, or of a list of sections ``b`` where ``a`` is None."""
    return Cascade(b) if a is None else Recursion(b, a)


def _edges(head: np.ndarray, tail: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """``pad`` points before and after a series, mirrored through its end points."""
    return 2 * head[0] - head[1 : pad + 1][::-1], 2 * tail[-1] - tail[-pad - 1 : -1][::-1]


def forward_backward(rows: list[np.ndarray], b, a, pad: int | None = None) -> list[np.ndarray]:
    """Filter each row forward and backward.

    ``a`` is None where ``b`` is a list of second-order sections. The ends are extended by ``pad`` mirrored points (3 * the number of
    coefficients by default, at most length - 1), and both passes start in the
    steady state of their first point.
    """
    rule = _rule(b, a)
    pads = [max(0, min(rule.default_pad if pad is None else pad, len(row) - 1)) for row in rows]
    extended = []
    for row, p in zip(rows, pads):
        before, after = _edges(row, row, p) if p else ([], [])
        extended.append(np.concatenate([before, row, after]))
    for _ in range(2):
        starts = np.array([row[0] if len(row) else 0.0 for row in extended])
        done, _ = rule.run(extended, np.outer(starts, rule.steady))
        extended = [row[::-1] for row in done]
    return [row[p : len(row) - p] for row, p in zip(extended, pads)]


def zero_phase(series: Column, b: list, a: list[float] | None, pad: int | None = None) -> Column:
    """Filtered copy of an ``array<double>`` column, one series per row."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        kept = batch[batch.notna()]
        done = forward_backward([np.asarray(row, dtype=float) for row in kept], b, a, pad)
        return pd.Series([row.tolist() for row in done], index=kept.index, dtype=object).reindex(batch.index)

    return run(series)


def gather_series(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, series)`` from ``(keys, sample, value)``.

    Only for segments cut to a fixed number of samples, which is then the
    length of each array. Whole recordings go through :func:`filter_recordings`.
    """
    cells = F.sort_array(F.collect_list(F.struct("sample", "value")))
    return long.groupBy(*keys).agg(F.transform(cells, lambda cell: cell["value"]).alias("series"))


def filter_recordings(
    df: DataFrame,
    keys: list[str],
    order_col: str,
    value_col: str,
    chunk: Column,
    b: list,
    a: list[float] | None,
    *,
    pad: int | None = None,
    out: str = "filtered",
) -> DataFrame:
    """Zero-phase filter of series of any length; adds nothing but ``out``.

    ``a`` is None where ``b`` is a list of second-order sections.

    A series is cut into chunks (``chunk`` is a function of the order column).
    Because the memory of the filter is linear, each chunk is first filtered
    from an empty memory, the memory at every chunk border follows from one
    small row per chunk, and the chunks are then filtered from their true
    start. This is done forward and backward, and gives the same numbers as
    one pass over the whole series.
    """
    rule = _rule(b, a)
    wanted_pad = rule.default_pad if pad is None else pad
    chunk_keys = [*keys, "_chunk"]
    placed = reduce(and_, (F.col(c).isNotNull() for c in [*keys, "_chunk"]))
    cells = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("at"), F.col(value_col).cast("double").alias("x"))))
    chunks = (
        df.withColumn("_chunk", chunk)
        .where(placed)
        .groupBy(*chunk_keys)
        .agg(cells.alias("_cells"))
        .select(
            *chunk_keys,
            F.transform("_cells", lambda c: c["at"]).alias("_at"),
            F.transform("_cells", lambda c: c["x"]).alias("_x"),
        )
    )

    def arrays(column: pd.Series) -> list[np.ndarray]:
        return [np.asarray(row, dtype=float) for row in column]

    @F.pandas_udf("array<double>")
    def leaves(series: pd.Series) -> pd.Series:
        rows = arrays(series)
        _, left = rule.run(rows, np.zeros((len(rows), len(rule.steady))))
        return pd.Series(left.tolist())

    @F.pandas_udf("array<double>")
    def filtered(series: pd.Series, memory: pd.Series) -> pd.Series:
        start = np.array(memory.tolist(), dtype=float).reshape(len(series), len(rule.steady))
        done, _ = rule.run(arrays(series), start)
        return pd.Series([row.tolist() for row in done])

    def borders_of(memory: np.ndarray, sizes, lefts) -> tuple[list, np.ndarray]:
        """Memory at the start of each chunk, and after the last one."""
        starts = []
        for n, left in zip(sizes, lefts):
            starts.append(memory.tolist())
            memory = rule.skip(memory, int(n)) + left
        return starts, memory

    def ends_of(parts: list, length: int) -> np.ndarray:
        """The first ``length`` points of consecutive parts."""
        taken = []
        for part in parts:
            taken += list(part)
            if len(taken) >= length:
                break
        return np.array(taken[:length], dtype=float)

    @F.pandas_udf("starts array<array<double>>, turn array<double>")
    def forward_borders(sizes: pd.Series, lefts: pd.Series, heads: pd.Series, tails: pd.Series) -> pd.DataFrame:
        out = []
        for n, left, head_parts, tail_parts in zip(sizes, lefts, heads, tails):
            p = min(wanted_pad, int(sum(n)) - 1)
            head = ends_of(head_parts, p + 1)
            tail = ends_of([part[::-1] for part in tail_parts[::-1]], p + 1)[::-1]
            before, after = _edges(head, tail, p) if p else (np.empty(0), np.empty(0))
            _, memory = rule.run([before], np.outer(before[0] if p else head[0], rule.steady))
            starts, memory = borders_of(memory[0], n, left)
            turn = None
            if p:
                past, _ = rule.run([after], memory[None])
                _, back = rule.run([past[0][::-1]], np.outer(past[0][-1], rule.steady))
                turn = back[0].tolist()
            out.append((starts, turn))
        return pd.DataFrame(out, columns=["starts", "turn"])

    @F.pandas_udf("array<array<double>>")
    def backward_borders(sizes: pd.Series, lefts: pd.Series, turns: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for n, left, turn, last in zip(sizes, lefts, turns, lasts):
            # Without an extension the backward pass starts at the last point.
            memory = rule.steady * last if turn is None else np.asarray(turn, dtype=float)
            starts, _ = borders_of(memory, n[::-1], left[::-1])
            out.append(starts[::-1])
        return pd.Series(out, dtype=object)

    def per_series(rows: DataFrame, *columns: str) -> DataFrame:
        """One row per series with its chunks' small values as arrays."""
        listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", *columns))).alias("_list"))
        return listed.select(*keys, *[F.col(f"_list.{c}").alias(c) for c in ("_chunk", *columns)])

    def per_chunk(rows: DataFrame, *keep: str) -> DataFrame:
        cells = F.explode(F.arrays_zip("_chunk", "_starts")).alias("_cell")
        return rows.select(*keys, *keep, cells).select(
            *keys, *keep, F.col("_cell._chunk").alias("_chunk"), F.col("_cell._starts").alias("_start")
        )

    edge = wanted_pad + 1
    summary = per_series(
        chunks.select(
            *chunk_keys,
            F.size("_x").alias("_n"),
            leaves("_x").alias("_left"),
            F.slice("_x", 1, edge).alias("_head"),
            F.slice("_x", F.greatest(F.size("_x") - edge, F.lit(0)) + 1, edge).alias("_tail"),
        ),
        "_n", "_left", "_head", "_tail",
    )
    found = summary.select(*keys, "_chunk", forward_borders("_n", "_left", "_head", "_tail").alias("_b"))
    borders = per_chunk(
        found.select(*keys, "_chunk", F.col("_b.starts").alias("_starts"), F.col("_b.turn").alias("_turn")), "_turn"
    )
    # Read twice below, so written once.
    forward = settle(
        chunks.join(borders, chunk_keys).select(
            *chunk_keys, "_at", "_turn", F.reverse(filtered("_x", "_start")).alias("_y")
        )
    )
    summary = per_series(
        forward.select(
            *chunk_keys, F.size("_y").alias("_n"), leaves("_y").alias("_left"), "_turn", F.get("_y", F.lit(0)).alias("_last")
        ),
        "_n", "_left", "_turn", "_last",
    )
    final = F.size("_n") - 1
    borders = per_chunk(
        summary.select(
            *keys,
            "_chunk",
            backward_borders("_n", "_left", F.get("_turn", F.lit(0)), F.get("_last", final)).alias("_starts"),
        )
    )
    done = forward.join(borders, chunk_keys).select(
        *keys, "_at", F.reverse(filtered("_y", "_start")).alias("_z")
    )
    return done.select(*keys, F.explode(F.arrays_zip("_at", "_z")).alias("_cell")).select(
        *keys, F.col("_cell._at").alias(order_col), F.col("_cell._z").alias(out)
    )
