"""Vocabulary index, fixed-length encoding, and words typical of a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.functions.text import clean_text, split_clean
from quillwave.functions.vectors import attention_mask, pad_ids
from quillwave.operators.ranking import global_rank, least_count
from quillwave.operators.skew import DEFAULT_LIMITS, JoinLimits, fits, text_partitions
from quillwave.operators.vectors import text_words
from quillwave.session import settle


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(word, n)`` over all texts."""
    return text_words(df, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_index(words: DataFrame) -> DataFrame:
    """``(word, word_index)``: 1-based position in byte order of the distinct words."""
    return global_rank(words.select("word").distinct(), [F.col("word")], "word_index")


def frequency_rank(counts: DataFrame) -> DataFrame:
    """``(word, n, place)``: 1-based position by falling count, then word."""
    return global_rank(counts, [F.col("n").desc(), F.col("word")], "place")


def encode_fixed_length(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocabulary: DataFrame,
    length: int,
    *,
    unknown_id: int,
    begin_id: int | None = None,
    end_id: int | None = None,
    pad_id: int = 0,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(id, input_ids, attention_mask)``, both of exactly ``length`` items.

    Words beyond the length are cut before anything is exchanged, so a text
    moves once with at most ``length`` words. A small vocabulary is broadcast.
    Of a larger one only the words that are most frequent in the texts are, and
    the others are looked up by a shuffle join.
    """
    room = length - (begin_id is not None) - (end_id is not None)
    tokens = F.slice(split_clean(clean_text(F.col(text_col))), 1, room)
    # A struct, as a key that is never NULL.
    cut = df.select(F.struct(id_col).alias("_key"), F.array_join(tokens, " ").alias("_cut")).repartition(text_partitions(df, text_col), "_key")
    words = cut.select("_key", F.posexplode_outer(split_clean(F.col("_cut"))).alias("_pos", "word"))
    known = settle(vocabulary.select("word", F.col("word_index").cast("int").alias("_id")))
    if fits(known, limits.broadcast_rows):
        gathered = _placed_ids(words.join(F.broadcast(known), "word", "left"), unknown_id)
    else:
        # Counted where the texts are read, before they are exchanged.
        listed = df.select(F.explode(tokens).alias("word")).where(F.col("word") != "")
        counted = settle(listed.groupBy("word").agg(F.count(F.lit(1)).alias("_n")))
        frequent = counted.where(F.col("_n") >= least_count(counted, "_n", limits.broadcast_rows)).select("word")
        hot = settle(frequent.join(known, "word", "left"))
        # Texts without words have no position; they stay on this side.
        here = F.col("_pos").isNull() | F.col("_hot")
        marked = words.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "word", "left")
        near = _placed_ids(marked.withColumn("_pos", F.when(here, F.col("_pos"))), unknown_id)
        rare = words.where("_pos IS NOT NULL").join(F.broadcast(hot.select("word")), "word", "left_anti")
        far = _placed_ids(rare.join(known, "word", "left"), unknown_id).withColumnRenamed("_ids", "_far")
        both = F.sort_array(F.concat("_ids", F.coalesce("_far", F.array().cast(far.schema["_far"].dataType))))
        gathered = near.join(far, "_key", "left").select("_key", both.alias("_ids"))
    gathered = gathered.select(F.col("_key")[id_col].alias(id_col), "_ids")
    ids = F.transform("_ids", lambda item: item["_id"])
    if begin_id is not None:
        ids = F.concat(F.array(F.lit(begin_id)), ids)
    if end_id is not None:
        ids = F.concat(ids, F.array(F.lit(end_id)))
    return gathered.select(id_col, ids.alias("_ids")).select(
        id_col,
        pad_ids(F.col("_ids"), length, pad_id).alias("input_ids"),
        attention_mask(F.col("_ids"), length).alias("attention_mask"),
    )


def _placed_ids(coded: DataFrame, unknown_id: int) -> DataFrame:
    """Positions and ids of the words of each text, in order; rows without a position add none."""
    placed = F.when(
        F.col("_pos").isNotNull(),
        F.struct("_pos", F.coalesce("_id", F.lit(unknown_id)).alias("_id")),
    )
    return coded.groupBy("_key").agg(F.sort_array(F.collect_list(placed)).alias("_ids"))


def word_class_counts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``(word, label, n)`` over all texts."""
    words = text_words(df, text_col, label_col)
    return words.groupBy("word", label_col).agg(F.count(F.lit(1)).alias("n"))


def salient_words(
    counts: DataFrame, label_col: str, classes: list[int], min_count: int, min_lift: float
) -> DataFrame:
    """Words that mostly occur in one class.

    ``counts`` is the result of :func:`word_class_counts`. Kept are pairs with
    n(word) >= min_count and P(class | word) / P(class) >= min_lift.
    """
    # Read twice, and much smaller than the texts it comes from.
    counts = settle(counts.where(F.col(label_col).isin(classes)))
    # One row per listed class, so the broadcast is bounded by the argument.
    per_class = counts.groupBy(label_col).agg(F.sum("n").alias("_class_n"))
    totals = per_class.agg(
        F.map_from_entries(F.collect_list(F.struct(label_col, "_class_n"))).alias("_by_class"),
        F.sum("_class_n").alias("_all"),
    ).first()
    by_class, everything = totals["_by_class"] or {}, totals["_all"] or 0
    per_word = counts.groupBy("word").agg(
        F.sum("n").alias("word_n"), F.collect_list(F.struct(F.col(label_col), F.col("n"))).alias("_pairs")
    )
    prior = F.create_map(
        *[F.lit(x) for label in classes for x in (int(label), by_class.get(label, 0) / max(everything, 1))]
    )
    return (
        per_word.where(F.col("word_n") >= min_count)
        .select("word", "word_n", F.inline("_pairs"))
        .withColumn("lift", (F.col("n") / F.col("word_n")) / F.try_element_at(prior, F.col(label_col)))
        .where(F.col("lift") >= min_lift)
    )
