"""Word-vector lookup and mean vectors of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.functions.text import clean_words
from quillwave.functions.vectors import indicators, ratio_or_zero, scale, zeros
from quillwave.operators.ranking import least_count
from quillwave.operators.skew import fits, text_partitions
from quillwave.session import settle


@dataclass(frozen=True)
class VectorLimits:
    """broadcast_bytes: largest vector table, in bytes of numbers, to broadcast.
    block: numbers of a vector that are summed as columns of one row.
    """

    broadcast_bytes: int = 256 << 20
    block: int = 16

    def words(self, dim: int) -> int:
        return max(1, self.broadcast_bytes // (4 * dim + 64))


DEFAULT_VECTOR_LIMITS = VectorLimits()

# Partitions of texts that share the vectors of their rare words: fewer copies of those, some hundred MB in a task.
GROUP_PARTITIONS = 8


def text_words(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per word of the cleaned text, next to the ``keep`` columns."""
    # explode_outer: the inner form makes Catalyst add a "not empty" filter,
    # which would evaluate the cleaning a second time.
    words = F.explode_outer(clean_words(F.col(text_col)))
    return df.select(*keep, words.alias("word")).where(F.col("word") != "")


def word_bags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, n)`` per text. The word '' stands for no word, so that a text
    without words keeps a row.

    The one shuffle moves each raw text once, by its unique id. Everything
    that is later grouped by the id stays where it is. The partitions are so
    many that the counts of one take little memory however many texts there are.
    """
    words = F.explode_outer(clean_words(F.col(text_col)))
    return (
        df.select(id_col, text_col)
        .repartition(text_partitions(df, text_col), id_col)
        .select(id_col, words.alias("word"))
        .groupBy(id_col, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _in_blocks(vectors: DataFrame, dim: int, block: int) -> DataFrame:
    parts = [F.slice("vector", start + 1, block) for start in range(0, dim, block)]
    return vectors.select("word", F.array(*parts).alias("_blocks"))


def store_vectors(
    vectors: DataFrame, table: str, dim: int, buckets: int, limits: VectorLimits = DEFAULT_VECTOR_LIMITS, path: str | None = None
) -> None:
    """Write ``(word, vector)`` as a table that is bucketed and sorted by word, at ``path`` or in the warehouse.

    Lookups in it (:func:`mean_vectors_stored`) never move the vectors again.
    Take as many buckets as a large lookup has partitions.
    """
    blocks = _in_blocks(vectors, dim, limits.block)
    # One file per bucket: the rows of a bucket are in one partition.
    laid = blocks.repartition(buckets, "word")
    writer = laid.write.mode("overwrite").bucketBy(buckets, "word").sortBy("word")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _block_sums(looked_up: DataFrame, id_col: str, block: int) -> DataFrame:
    """Sum the found vectors per (id, block); unknown words form a NULL block."""
    flat = looked_up.select(id_col, "word", "n", F.posexplode_outer("_blocks").alias("_block", "_part"))
    counts_once = F.col("_block").isNull() | (F.col("_block") == 0)
    tokens = F.sum(F.when(counts_once & (F.col("word") != ""), F.col("n")).otherwise(F.lit(0)))
    sums = [
        F.sum(F.get("_part", F.lit(i)).cast("double") * F.col("n")).alias(f"_s{i}") for i in range(block)
    ]
    return flat.groupBy(id_col, "_block").agg(tokens.alias("_tokens"), *sums)


def _group_sums(bags: DataFrame, id_col: str, blocks: DataFrame, groups: int, dim: int, block: int) -> DataFrame:
    """The sums of :func:`_block_sums` without a vector for each word of each text.

    A group of texts is sent the vector of each of its words once, and sums
    are made where both meet. ``groups`` are so many that one fits a task.
    """
    grouped = bags.withColumn("_group", F.pmod(F.hash(id_col), F.lit(groups)))
    cells = [(b, i) for b in range(-(-dim // block)) for i in range(block)]
    numbers = [F.get(F.get("_blocks", F.lit(b)), F.lit(i)).alias(f"_v{b}_{i}") for b, i in cells]
    found = grouped.select("_group", "word").distinct().join(blocks, "word").select(F.col("_group").alias("_to"), F.col("word").alias("_word"), *numbers)
    sums = [f"_s{i}" for i in range(block)]
    schema = f"`{id_col}` {dict(bags.dtypes)[id_col]}, _block int, _tokens bigint, " + ", ".join(f"{name} double" for name in sums)

    def run(texts: pa.Table, vectors: pa.Table) -> pa.Table:
        numbered = vectors.select(["_word"]).append_column("_row", pa.array(np.arange(len(vectors))))
        pairs = texts.select([id_col, "word", "n"]).join(numbered, "word", "_word", "left outer", use_threads=False)
        ids = pairs[id_col].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, n = ids.indices.to_numpy(), pairs["n"].to_numpy().astype(float)
        size, names = len(ids.dictionary), [id_col, "_block", "_tokens", *sums]
        at = pairs["_row"].combine_chunks()
        known = at.is_valid().to_numpy(zero_copy_only=False)
        # Words without a vector count too, in rows without a block; a NULL word stands for a NULL text.
        counted = pairs["word"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        tokens = pa.array(np.bincount(codes, n * counted, size).astype(np.int64))
        nothing = pa.nulls(size, pa.float64())
        out = [pa.Table.from_arrays([ids.dictionary, pa.nulls(size, pa.int32()), tokens, *[nothing] * block], names)]
        codes, n, at = codes[known], n[known], at.drop_null().to_numpy()
        some = np.unique(codes)
        for b in range(-(-dim // block) if len(some) else 0):
            columns = []
            for i in range(block):
                column = vectors[f"_v{b}_{i}"].combine_chunks().cast(pa.float64())
                there = column.is_valid().to_numpy(zero_copy_only=False)[at]
                weights = np.where(there, column.fill_null(0.0).to_numpy()[at], 0.0) * n
                held = np.bincount(codes, there, size)[some] > 0
                columns.append(pa.array(np.bincount(codes, weights, size)[some], mask=~held))
            place = [pa.array(np.full(len(some), b, np.int32)), pa.array(np.zeros(len(some), np.int64))]
            out.append(pa.Table.from_arrays([ids.dictionary.take(pa.array(some)), *place, *columns], names))
        return pa.concat_tables(out)

    rows = grouped.select("_group", id_col, "word", "n").groupBy("_group")
    return rows.cogroup(found.groupBy("_to")).applyInArrow(run, schema)


def mean_vectors(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vectors: DataFrame,
    dim: int,
    limits: VectorLimits = DEFAULT_VECTOR_LIMITS,
) -> DataFrame:
    """Mean word vector per text: sum of known vectors / number of all words.

    Result ``(id, n_tokens, vector)``; a text without words gets zeros.
    ``vectors`` is ``(word, vector)`` with one row per word. A table within
    the limit is broadcast. Beyond it, only the vectors of the words that
    occur in most texts are broadcast. Those of the rare words are sent once to
    each group of texts that has the word, so no task ever gets all rows of a
    frequent word.
    """
    return _mean(df, id_col, text_col, settle(_in_blocks(vectors, dim, limits.block)), dim, limits)


def mean_vectors_stored(
    df: DataFrame, id_col: str, text_col: str, table: str, dim: int, limits: VectorLimits = DEFAULT_VECTOR_LIMITS
) -> DataFrame:
    """:func:`mean_vectors` against a table of :func:`store_vectors` with the same block size.

    Beyond the size of a broadcast, only the rare words of the texts are
    exchanged; the stored side is read bucket by bucket.
    """
    return _mean(df, id_col, text_col, df.sparkSession.table(table), dim, limits)


def _mean(df: DataFrame, id_col: str, text_col: str, blocks: DataFrame, dim: int, limits: VectorLimits) -> DataFrame:
    """Mean vectors from a written table ``(word, _blocks)``."""
    bags = word_bags(df, id_col, text_col)
    most = limits.words(dim)
    if fits(blocks, most):
        sums = _block_sums(bags.join(F.broadcast(blocks), "word", "left"), id_col, limits.block)
    else:
        counted = settle(bags.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("_texts")))
        frequent = counted.where(F.col("_texts") >= least_count(counted, "_texts", most)).select("word")
        # Empty texts ('' as word) can be many too: they stay on the hot side.
        hot = settle(
            frequent.unionByName(frequent.sparkSession.createDataFrame([("",)], "word string"))
            .join(blocks, "word", "left")
        )
        hot_sums = _block_sums(bags.join(F.broadcast(hot), "word"), id_col, limits.block)
        rare = bags.join(F.broadcast(hot.select("word")), "word", "left_anti")
        rare_sums = _group_sums(rare, id_col, blocks, -(-text_partitions(df, text_col) // GROUP_PARTITIONS), dim, limits.block)
        sums = (
            hot_sums.unionByName(rare_sums)
            .groupBy(id_col, "_block")
            .agg(*[F.sum(c).alias(c) for c in hot_sums.columns if c not in (id_col, "_block")])
        )
    return _assemble(sums, id_col, dim, limits.block)


def _assemble(sums: DataFrame, id_col: str, dim: int, block: int) -> DataFrame:
    """Put the blocks of a text (dim / block of them) side by side and divide."""
    known = F.when(
        F.col("_block").isNotNull(),
        F.struct("_block", F.array(*[f"_s{i}" for i in range(block)]).alias("_values")),
    )
    per_text = sums.groupBy(id_col).agg(
        F.sum("_tokens").alias("n_tokens"), F.sort_array(F.collect_list(known)).alias("_found")
    )
    total = F.slice(F.flatten(F.transform("_found", lambda b: b["_values"])), 1, dim)
    mean = F.transform(total, lambda value: ratio_or_zero(value, F.col("n_tokens")))
    return per_text.select(
        id_col,
        "n_tokens",
        F.when(F.size("_found") == 0, zeros(dim)).otherwise(mean).alias("vector"),
    )


def unknown_words(df: DataFrame, text_col: str, vectors: DataFrame) -> DataFrame:
    """``(word, n)`` for the words that have no vector.

    The words are counted first, so a frequent word is one row in the join.
    """
    counts = text_words(df, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vectors.select("word"), "word", "left_anti")


def require_known(df: DataFrame, text_col: str, vectors: DataFrame) -> None:
    """Strict lookup: fail, naming some of them, if there are unknown words."""
    sample = unknown_words(df, text_col, vectors).orderBy("word").limit(20).collect()
    if sample:
        raise KeyError(f"words without a vector: {[row['word'] for row in sample]}")


def reweighted(vectors: DataFrame, words: DataFrame, factor: float = 2.0) -> DataFrame:
    """Vector table in which the vectors of ``words`` are multiplied by ``factor``."""
    marked = vectors.join(words.select("word", F.lit(True).alias("_marked")), "word", "left")
    raised = F.when(F.col("_marked"), scale(F.col("vector"), F.lit(factor).cast("float")))
    return marked.select("word", raised.otherwise(F.col("vector")).alias("vector"))


def with_keyword_indicators(
    df: DataFrame, id_col: str, text_col: str, features: DataFrame, keywords: list[str]
) -> DataFrame:
    """Append one 0/1 number per keyword to the ``vector`` of each text."""
    tokens = clean_words(F.col(text_col))
    # The same repartitioned scan as in word_bags, so the exchange is reused.
    flags = df.select(id_col, text_col).repartition(text_partitions(df, text_col), id_col).select(
        id_col, indicators(tokens, keywords).alias("_flags")
    )
    return features.join(flags, id_col).withColumn("vector", F.concat("vector", "_flags")).drop("_flags")


def exploded(df: DataFrame, id_col: str, vector: str | Column = "vector") -> DataFrame:
    """Long form ``(id, k, value)`` of a vector column."""
    return df.select(id_col, F.posexplode(vector).alias("k", "value"))
