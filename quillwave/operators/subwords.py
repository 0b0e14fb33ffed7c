"""Sub-word encoding: each word as the longest pieces of a vocabulary, from left to right.

Pieces inside a word carry a mark (``##`` by default) in the vocabulary. Only
distinct words are matched: their substrings meet the vocabulary in an equi
join, the longest piece at each position is kept, and one pass over the
positions follows the pieces from the start. The vocabulary is broadcast while
it is small and shuffled with the substrings beyond that; no task needs it
whole.

Defined results: a word that can't be covered, or that is longer than
``most_chars``, is one unknown id. Null or word-less text is all padding. Words
beyond the length are cut before any lookup, as each gives one id or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.functions.text import clean_text, split_clean
from quillwave.functions.vectors import attention_mask, pad_ids
from quillwave.operators.skew import DEFAULT_LIMITS, JoinLimits, attach_by_key
from quillwave.session import settle


def _substrings(words: DataFrame, longest: int, mark: str) -> DataFrame:
    """``(word, start, size, piece)`` for all substrings of up to ``longest`` characters."""
    from_start = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))
    each = from_start.select("word", "start", F.explode(sizes).alias("size"))
    part = F.substring("word", F.col("start") + 1, F.col("size"))
    piece = F.when(F.col("start") == 0, part).otherwise(F.concat(F.lit(mark), part))
    return each.select("word", "start", "size", piece.alias("piece"))


def _followed(best: Column, size: Column) -> Column:
    """Ids along the longest pieces from position 0; null where no piece fits."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(held: Column, position: Column) -> Column:
        found = F.try_element_at(best, position)
        after = F.struct((position + found["size"]).alias("at"), F.concat(held["ids"], F.array(found["id"])).alias("ids"))
        return F.when(held["at"] == position, after).otherwise(held)

    # Without a piece at a position that is reached, "at" becomes null and stays so.
    last = F.aggregate(F.sequence(F.lit(0), size - 1), start, step)
    return F.when(last["at"] == size, last["ids"])


def word_pieces(
    words: DataFrame,
    vocabulary: DataFrame,
    *,
    unknown_id: int,
    mark: str = "##",
    most_chars: int = 100,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(word, ids)`` for distinct ``words``; ``vocabulary`` is ``(piece, piece_id)``, one row per piece."""
    words = settle(words.select("word"))
    inner = F.length("piece") - F.when(F.startswith("piece", F.lit(mark)), len(mark)).otherwise(0)
    longest = vocabulary.agg(F.max(F.greatest(inner, F.length("piece") - len(mark))).alias("n")).first()["n"] or 1
    spans = _substrings(words.where(F.length("word").between(1, most_chars)), max(longest, 1), mark)
    known = vocabulary.select("piece", F.col("piece_id").cast("int").alias("id"))
    found = attach_by_key(spans, known, ["piece"], limits=limits)
    best = found.groupBy("word", "start").agg(F.max(F.struct("size", "id")).alias("best"))
    by_word = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "best"))).alias("_best"))
    joined = words.join(by_word, "word", "left")
    ids = F.when(F.col("_best").isNotNull(), _followed(F.col("_best"), F.length("word")))
    return joined.select("word", F.coalesce(ids, F.array(F.lit(unknown_id))).alias("ids"))


def encode_subwords(
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
    mark: str = "##",
    most_chars: int = 100,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(id, input_ids, attention_mask)``, both of exactly ``length`` items.

    Texts are cut to words where they are scanned; ids and positions are all
    that is exchanged.
    """
    room = length - (begin_id is not None) - (end_id is not None)
    tokens = F.slice(split_clean(clean_text(F.col(text_col))), 1, room)
    rows = df.select(id_col, F.posexplode_outer(tokens).alias("_pos", "word"))
    pieces = word_pieces(
        rows.where("word IS NOT NULL").select("word").distinct(), vocabulary,
        unknown_id=unknown_id, mark=mark, most_chars=most_chars, limits=limits,
    )
    coded = attach_by_key(rows, pieces, ["word"], how="left", limits=limits)
    placed = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "ids"))
    gathered = coded.groupBy(id_col).agg(F.sort_array(F.collect_list(placed)).alias("_words"))
    ids = F.slice(F.flatten(F.transform("_words", lambda w: w["ids"])), 1, room)
    if begin_id is not None:
        ids = F.concat(F.array(F.lit(begin_id)), ids)
    if end_id is not None:
        ids = F.concat(ids, F.array(F.lit(end_id)))
    return gathered.select(id_col, ids.alias("_ids")).select(
        id_col,
        pad_ids(F.col("_ids"), length, pad_id).alias("input_ids"),
        attention_mask(F.col("_ids"), length).alias("attention_mask"),
    )
