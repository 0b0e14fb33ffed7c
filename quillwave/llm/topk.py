"""Exact top-k by inner product, a block of documents at a time.

Vectors are turned into integers and laid out in id order. Blocks of
consecutive vectors keep the largest value of every term, where a component is
two terms, one per sign. A query orders the blocks of a range by the sum of its
terms times those maxima, an upper bound of all scores in the block, and scores
them through the block's forward index (its rows) until the bound of the next
block is below its k-th best score. Queries run in groups against one range of
blocks at a time; the ranges' winners are merged by a window.

Defined results: vectors that are null, or hold null or non-finite components,
take no part. Shorter vectors count as padded with zeros. Rows that share an id
are one vector (the smallest). Null ids take no part. Fewer candidates than k:
all are returned. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema, on_batches, written

_NONE = -(2**62)


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows of (``name``, ids, width, values): at most ``rows`` vectors in id order each."""
    schema = f"{name} bigint, ids binary, width int, numbers binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                values = part.column(1)
                sizes = np.diff(values.offsets.to_numpy())
                width = int(sizes.max())
                matrix = np.zeros((len(sizes), width), "<i8")
                matrix[np.arange(width) < sizes[:, None]] = values.flatten().to_numpy()
                ids = part.column(0).to_numpy().astype("<i8")
                row = [[number], [ids.tobytes()], [width], [matrix.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, arrow)], schema=arrow)
                number += 1

    return df.mapInArrow(run, schema)


class Best:
    """The k best (score, id) of each query so far; ties go to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), _NONE, np.int64)
        self.ids = np.full((queries, k), 2**63 - 1, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        scores = np.concatenate([self.scores[at], scores], axis=1)
        ids = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[at] = np.take_along_axis(scores, order, axis=1)
        self.ids[at] = np.take_along_axis(ids, order, axis=1)


def search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int
) -> tuple[Best, int]:
    """Best k of ``vectors`` (in id order) per query, and how many scores were computed."""
    exact = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2**53
    # Integer products are exact in float64 up to 2^53; larger ones stay Python integers.
    kind = np.float64 if exact else object
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    starts = np.arange(0, len(ids), block)
    highest = np.maximum.reduceat(vectors, starts, axis=0)
    lowest = np.minimum.reduceat(vectors, starts, axis=0)
    bound = np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best, scored = Best(len(queries), k), 0
    for turn in range(len(starts)):
        mine = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(queries)), mine] >= best.scores[:, -1])
        if not len(active):
            break
        for number in np.unique(mine[active]):
            at = active[mine[active] == number]
            part = slice(starts[number], starts[number] + block)
            scores = (queries[at] @ vectors[part].T).astype(np.int64)
            scores[query_ids[at][:, None] == ids[part]] = _NONE
            best.add(at, scores, ids[part])
            scored += scores.size
    return best, scored


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    block: int = 64,
    range_rows: int = 8192,
    group_rows: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows where ``is_query`` holds, against all others."""
    usable = F.forall(F.col("_v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("_id"), is_query.alias("_q"), F.col(vector_col).cast("array<double>").alias("_v"))
        .where(usable & (F.size("_v") > 0))
        .select("_id", "_q", F.transform("_v", lambda x: F.floor(x * scale).cast("bigint")).alias("_v"))
        .groupBy("_id")
        .agg(F.min("_v").alias("_v"), F.max("_q").alias("_q"))
    )
    rows = written(rows, "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.sum(F.col("_q").cast("bigint"))).first()
    parts = max(1, -(-total // range_rows))
    laid = rows.select("_id", "_v").repartitionByRange(parts, "_id").sortWithinPartitions("_id")
    ranges = written(_packed(laid, range_rows, "range"), "ranges")
    groups = max(1, -(-(asked or 0) // group_rows))
    asking = rows.where("_q").select("_id", "_v").repartition(groups, "_id").sortWithinPartitions("_id")
    asking = written(_packed(asking, group_rows, "number"), "queries")
    # Every group of queries meets every range once, by two joins on their numbers.
    numbers = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    pairs = ranges.select("range", numbers.alias("part"))
    asking = asking.withColumn("part", F.shiftright("number", 24).cast("int"))
    met = pairs.join(asking.select("part", F.col("ids").alias("qi"), F.col("width").alias("qw"), F.col("numbers").alias("qn")), "part")
    met = met.join(ranges, "range")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for row in batch.to_pylist():
            query_ids, ids = np.frombuffer(row["qi"], "<i8"), np.frombuffer(row["ids"], "<i8")
            queries = np.frombuffer(row["qn"], "<i8").reshape(-1, row["qw"])
            found = np.frombuffer(row["numbers"], "<i8").reshape(-1, row["width"])
            width = min(row["qw"], row["width"])
            best, _ = search(query_ids, queries[:, :width], ids, found[:, :width], k, block)
            there = best.scores > _NONE
            yield [np.repeat(query_ids, there.sum(axis=1)), best.ids[there], best.scores[there]]

    found = on_batches(
        met.select("qi", "qw", "qn", "ids", "width", "numbers"), run, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
