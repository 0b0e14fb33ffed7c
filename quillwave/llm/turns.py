"""Turns of conversations in order, also where one conversation holds most rows.

Turns are ordered by ``turn`` (null first), then by the digest of role and
text. A null role or text is empty. Repeated rows are repeated turns. Rows of a
null conversation id are one conversation of their own.

Conversations of up to ``most`` turns are gathered in one row by one shuffle.
The rows of longer ones are ranked over range partitions, so their turns are
spread over many tasks and no task gets one whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import written
from quillwave.operators.ranking import global_rank
from quillwave.operators.skew import attach_by_key


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn; the length of the role keeps role and text apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, role, text) without nulls in role and text."""
    held = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    return held.select("conv_id", "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), "role", "text")


def by_length(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (conv_id, turn, digest, ...) of conversations of up to ``most`` turns, and of longer ones.

    The first result has one row per conversation: (conv_id, turns), an ordered
    array of structs of all other columns. The second has one row per turn with
    its position ``pos`` from 0 and ``n``, the number of turns.
    """
    counts = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = written(counts, "long").select(F.col("conv_id").alias("_long"), "n")
    same = rows["conv_id"].eqNullSafe(large["_long"])
    items = F.struct(*[c for c in rows.columns if c != "conv_id"])
    short = rows.join(large, same, "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list(items)).alias("turns"))

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranked = global_rank(rows.join(large, same, "inner").drop("_long"), order, "_rank")
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    placed = attach_by_key(ranked, first, ["conv_id"], null_safe=True)
    return short, placed.withColumn("pos", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def numbered(rows: DataFrame, most: int = 256) -> DataFrame:
    """``rows`` with the position ``pos`` of each turn in its conversation."""
    short, long = by_length(rows, most)
    others = [c for c in rows.columns if c != "conv_id"]
    each = short.select("conv_id", F.posexplode("turns").alias("pos", "_t"))
    flat = each.select("conv_id", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"_t.{c}").alias(c) for c in others])
    return flat.unionByName(long.drop("n"))
