import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators.skew import JoinLimits
from quillwave.operators.subwords import encode_subwords, word_pieces

PIECES = ["un", "able", "##able", "##aff", "##a", "##ff", "a", "b", "##b", "ab", "##ba", "é", "##é", "##bab"]


def greedy(word, known, unknown, most=100):
    if len(word) > most:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in known:
                out.append(known[piece])
                at = end
                break
        else:
            return [unknown]
    return out


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(p, i + 2) for i, p in enumerate(PIECES)], "piece string, piece_id long")


@pytest.mark.parametrize("limits", [JoinLimits(), JoinLimits(broadcast_rows=0)])
def test_longest_match(spark, vocabulary, limits):
    draw = random.Random(0)
    known = {p: i + 2 for i, p in enumerate(PIECES)}
    words = {"".join(draw.choice("abéf") for _ in range(draw.randint(1, 9))) for _ in range(200)} | {"unaffable", "unable", "ab" * 60, "x"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in word_pieces(df, vocabulary, unknown_id=1, limits=limits).collect()}
    assert got == {w: greedy(w, known, 1) for w in words}
    assert len(got["unaffable"]) == 3 and got["ab" * 60] == [1]


def test_encoding(spark, vocabulary):
    texts = [(1, "Unaffable, AB bab!"), (2, None), (3, ""), (4, "ab " * 40), (5, "ab x")]
    df = spark.createDataFrame(texts, "id int, text string")
    out = encode_subwords(df, "id", "text", vocabulary, 8, unknown_id=1, begin_id=90, end_id=91)
    got = {r.id: (list(r.input_ids), sum(r.attention_mask)) for r in out.collect()}
    known = {p: i + 2 for i, p in enumerate(PIECES)}
    first = [*greedy("unaffable", known, 1), *greedy("ab", known, 1), *greedy("bab", known, 1)]
    assert len(first) == 7 and got[1] == ([90, *first[:6], 91], 8)
    assert got[2] == got[3] == ([90, 91] + [0] * 6, 2)
    assert got[4] == ([90] + [known["ab"]] * 6 + [91], 8)
    assert got[5] == ([90, known["ab"], 1, 91, 0, 0, 0, 0], 4)


def test_empty_vocabulary(spark, vocabulary):
    df = spark.createDataFrame([("ab",)], "word string")
    assert rows(word_pieces(df, vocabulary.limit(0), unknown_id=1).withColumn("ids", F.concat_ws(" ", F.col("ids").cast("array<string>")))) == [("ab", "1")]
