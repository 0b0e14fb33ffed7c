"""Spelling variants by PartEnum signatures of letter multisets.

Words are near if they differ by exactly one inserted, deleted or replaced
code point. The letters of a word with their running numbers (the second e is
another element than the first) are a binary vector, and near words differ in
at most two of its places. Its dimensions are dealt over three partitions: two
differences leave one of them equal, so the contents of each partition are an
exact signature. One change also leaves the first or the last half of a word
alone; each signature is taken together with either half, which keeps the
groups of words with equal letters apart. Words are equi-joined on the
signatures. The distance of the vectors is checked on 64-bit sums modulo two
before the words themselves are compared.

A group's words are joined with the words of its own length only as often as
the pairs are verified; no group is gathered in one row, and adaptive
execution splits a signature that many words share.

Defined results: null and word-less texts have no words. A null id counts as
an empty one. Repeated rows count again. Extra columns are not read. No rows
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTITIONS = 3


def words(docs: DataFrame, least: int = 7, drop_one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all letter runs of ``least`` code points or more.

    A run whose checksum with the document's id is divisible by ``drop_one_in``
    loses the code point that the checksum points at.
    """
    # Shorter runs can't give words of that length.
    pattern = f"[a-zÀ-ÿ]{{{least},}}"
    run = F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _UPPER.lower()), F.lit(pattern), 0))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("_name"), run.alias("_run"))
    runs = runs.select("_run", F.crc32(F.concat("_name", F.lit(":"), "_run").cast("binary")).alias("_sum"), F.length("_run").alias("_size"))
    at = F.pmod("_sum", "_size").cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.col("_size")))
    word = F.when(F.col("_sum") % drop_one_in == 0, cut).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _folded(elements: Column, bit: bool = False) -> Column:
    """Exclusive or of the hashes, or of one bit of 64 for each."""

    def step(held: Column, x: Column) -> Column:
        return held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int")) if bit else x)

    return F.aggregate(elements, F.lit(0).cast("bigint"), step)


def _of_partition(k: int):
    return lambda x: F.pmod(F.shiftright(x, 8), F.lit(_PARTITIONS)) == k


def signatures(counted: DataFrame) -> DataFrame:
    """(signature, word, n, size, own, bits): ``own`` where the word has the shorter length of the pairs sought."""
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    elements = F.transform("_letters", lambda c, i: F.xxhash64(c, i - F.array_position("_letters", c).cast("int")))
    base = counted.withColumn("_letters", letters).withColumn("_elements", elements)
    parts = [_folded(F.filter("_elements", _of_partition(k))).alias(f"_part{k}") for k in range(_PARTITIONS)]
    base = base.select("word", "n", F.length("word").alias("size"), _folded(F.col("_elements"), bit=True).alias("bits"), *parts)
    each = []
    for below in (0, 1):
        shorter = F.col("size") - below
        half = F.floor(shorter / 2).cast("int")
        for side, kept in enumerate((F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - half + 1, half))):
            for k in range(_PARTITIONS):
                signature = F.xxhash64(F.lit(k), F.lit(side), shorter, kept, f"_part{k}")
                each.append(F.struct(signature.alias("signature"), F.lit(below == 0).alias("own")))
    return base.select("word", "n", "size", "bits", F.explode(F.array(*each)).alias("_s")).select(
        "_s.signature", "word", "n", "size", "_s.own", "bits"
    )


def near_words(counted: DataFrame) -> DataFrame:
    """All pairs (word, n, other, other_n) of near words of the written table (word, n), each once."""
    rows = written(signatures(counted), "signatures")
    left = rows.where("own").select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
    right = rows.select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), "own")
    close = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    verified = F.levenshtein("a", "b", 1) == 1
    found = left.join(right, "signature").where(once & close).where(verified)
    pairs = written(found.select("a", "a_n", "b", "b_n").distinct(), "pairs")
    return pairs.toDF("word", "n", "other", "other_n")


def last_of_chain(forms: DataFrame) -> DataFrame:
    """(word, root) of the written table (word, form): the last word that forms lead to.

    Each round looks up the root of the root, so paths double. A form occurs
    ten times as often as its word: there are no cycles and few rounds.
    """
    held = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        held = written(held.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if held.where("_moved").isEmpty():
            return held.drop("_moved")
        held = held.drop("_moved")


def variants(
    docs: DataFrame, least: int = 7, min_n: int = 2, times: int = 10, drop_one_in: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, ties to the smallest, if that
    is at least ``times`` its own n.
    """
    counted = written(words(docs, least, drop_one_in, id_col, text_col).where(F.col("n") >= min_n), "words")
    pairs = near_words(counted)
    both = pairs.unionByName(pairs.toDF("other", "other_n", "word", "n"))
    rank = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))
    every = both.select("word", "n", rank.alias("rank")).unionByName(counted.select("word", "n", F.lit(None).cast("struct<less:bigint,other:string>").alias("rank")))
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.count("rank").alias("n_near"), F.min("rank").alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    held = written(best.select("word", "n", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = last_of_chain(held.where("form IS NOT NULL").select("word", "form"))
    out = held.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
