"""Synonym replacement for rare classes."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.functions.text import repeatable_key, replace_tokens, split_single_space
from quillwave.operators.ranking import global_rank
from quillwave.operators.skew import DEFAULT_LIMITS, JoinLimits, attach_by_key
from quillwave.operators.split import weight_of
from quillwave.session import settle


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def candidate_words(df: DataFrame, id_col: str, text_col: str, stop_words: list[str]) -> DataFrame:
    """Distinct words per text without the stop words (case sensitive)."""
    stops = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    words = F.array_except(F.array_distinct(split_single_space(F.col(text_col))), stops)
    return df.select(id_col, F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())


def synonym_augment(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    weights: list[int],
    synonyms: DataFrame,
    *,
    stop_words: list[str] | None = None,
    n_words: int = 5,
    seed: int | str = 42,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``weights[label]`` extra copies per row with up to ``n_words`` words replaced.

    ``synonyms`` is ``(word, synonym)``. In each copy the words are drawn, and
    one synonym per word is drawn, by hash. All copies of a chosen word in the
    text are replaced. Result ``(id, copy, text, label)``, originals as copy 0.
    """
    stops = default_stop_words() if stop_words is None else stop_words
    # Number all pairs once; a word then owns the slots base .. base + size - 1
    # and a draw is an equi join on one slot, not a join with every synonym.
    slots = settle(
        global_rank(
            synonyms.select("word", "synonym").distinct(), [F.col("word"), F.col("synonym")], "slot"
        )
    )
    owned = slots.groupBy("word").agg(F.min("slot").alias("_base"), F.count(F.lit(1)).alias("_size"))

    rows = df.select(
        id_col, text_col, label_col, weight_of(F.col(label_col), weights).alias("_weight")
    ).repartition(id_col)
    wanted = rows.where(F.col("_weight") > 0)
    found = attach_by_key(
        candidate_words(wanted, id_col, text_col, stops), owned, ["word"], limits=limits
    )
    copies = wanted.select(id_col, F.explode(F.sequence(F.lit(1), F.col("_weight"))).alias("copy"))
    draws = found.join(copies, id_col).withColumn(
        "_key", repeatable_key(seed, F.col(id_col), F.col("copy"), F.col("word"))
    )
    # One text's distinct words at most in each window group.
    order = Window.partitionBy(id_col, "copy").orderBy("_key", "word")
    chosen = draws.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= n_words)
    # The first 8 hex digits of the key pick the slot.
    pick = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    # At most n_words narrow rows per copy; written so that looking for hot
    # slots does not draw again.
    chosen = settle(
        chosen.select(id_col, "copy", "word", (F.col("_base") + F.pmod(pick, F.col("_size"))).alias("slot"))
    )
    swaps = (
        attach_by_key(
            chosen, slots.select("slot", "synonym"), ["slot"], limits=limits, settled=True
        )
        .groupBy(id_col, "copy")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "synonym"))).alias("_swaps"))
        # All copies of a text in one row: the text itself is joined once, and copied last.
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("copy", "_swaps"))).alias("_by_copy"))
    )
    every = rows.join(swaps, id_col, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_weight"))))
    own = F.try_element_at("_by_copy", F.col("copy"))
    text = F.when(own.isNull(), F.col(text_col)).otherwise(
        F.array_join(replace_tokens(split_single_space(F.col(text_col)), own), " ")
    )
    return every.select(id_col, "copy", text.alias(text_col), label_col)
