import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from quillwave.functions import vectors as vx
from quillwave.operators import vectors, vocabulary
from quillwave.operators.skew import JoinLimits

DIM = 21


@pytest.fixture(scope="module")
def fixture(spark):
    draw = random.Random(2)
    table = {f"w{i}": [draw.uniform(-1, 1) for _ in range(DIM)] for i in range(30)}
    table = {w: [float(np.float32(x)) for x in v] for w, v in table.items()}
    texts = {}
    for i in range(80):
        # "w0" is in most texts; w30 and up are unknown.
        words = ["W0,"] * draw.randint(0, 3) + [f"w{draw.randint(0, 40)}" for _ in range(draw.randint(0, 12))]
        texts[i] = " ".join(words)
    texts[80], texts[81], texts[82] = "", "?!", "unknown words only"
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    vec = spark.createDataFrame(list(table.items()), "word string, vector array<float>")
    return texts, table, df, vec


def expected_mean(text, table):
    words = text.lower().replace(",", "").replace("?", "").replace("!", "").split()
    total = np.zeros(DIM)
    for w in words:
        if w in table:
            total += np.array(table[w])
    return total / len(words) if words else total


@pytest.mark.parametrize("limits", [vectors.VectorLimits(), vectors.VectorLimits(broadcast_bytes=1, block=4),
                                    vectors.VectorLimits(broadcast_bytes=4 * (4 * DIM + 64), block=16)])
def test_mean_vectors_both_ways(fixture, limits):
    texts, table, df, vec = fixture
    got = {r.id: r for r in vectors.mean_vectors(df, "id", "text", vec, DIM, limits).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        np.testing.assert_allclose(got[i].vector, expected_mean(text, table), atol=1e-9)
    assert got[80].n_tokens == 0 and got[82].n_tokens == 3


def test_mean_vector_plan(fixture):
    _, _, df, vec = fixture
    text = plan(vectors.mean_vectors(df, "id", "text", vec, DIM))
    assert text.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text
    assert text.count("translate(") == 1


def test_unknown_and_strict(fixture):
    texts, table, df, vec = fixture
    found = {r.word for r in vectors.unknown_words(df, "text", vec).collect()}
    assert {"unknown", "words", "only"} <= found and not found & set(table)
    with pytest.raises(KeyError, match="only"):
        vectors.require_known(df.where("id = 82"), "text", vec)
    vectors.require_known(df.where("id = 80"), "text", vec)


def test_reweighted_and_keywords(spark, fixture):
    texts, table, df, vec = fixture
    heavy = vectors.reweighted(vec, spark.createDataFrame([("w0",)], "word string"), 2.0)
    doubled = {r.word: list(r.vector) for r in heavy.collect()}
    assert doubled["w0"] == pytest.approx([2 * x for x in table["w0"]])
    assert doubled["w1"] == pytest.approx(table["w1"])
    features = vectors.mean_vectors(df, "id", "text", vec, DIM)
    wide = vectors.with_keyword_indicators(df, "id", "text", features, ["w0", "only"])
    got = {r.id: r.vector[DIM:] for r in wide.collect()}
    assert got[82] == [0.0, 1.0] and got[80] == [0.0, 0.0]
    assert all(got[i][0] == float("W0," in t or "w0" in t.split()) for i, t in texts.items())


@pytest.mark.parametrize("limits", [JoinLimits(), JoinLimits(broadcast_rows=0)])
def test_encoding(spark, fixture, limits):
    texts, _, df, _ = fixture
    vocab = vocabulary.vocabulary_index(vectors.text_words(df, "text"))
    index = {r.word: r.word_index for r in vocab.collect()}
    assert [w for w, _ in sorted(index.items(), key=lambda p: p[1])] == sorted(index)
    got = vocabulary.encode_fixed_length(
        df, "id", "text", vocab.where("word <> 'w0'"), 8, unknown_id=999, begin_id=101, end_id=102, limits=limits
    )
    for r in got.collect():
        words = texts[r.id].lower().translate(str.maketrans("", "", ",?!")).split()[:6]
        ids = [101] + [999 if w == "w0" else index[w] for w in words] + [102]
        assert r.input_ids == ids + [0] * (8 - len(ids))
        assert r.attention_mask == [1] * len(ids) + [0] * (8 - len(ids))


def test_salient_words(spark):
    data = [(0, "bad bad film", 0), (1, "worse film", 0), (2, "good film", 1), (3, "good good fun", 1)]
    df = spark.createDataFrame(data, "id int, text string, label int")
    counts = vocabulary.word_class_counts(df, "text", "label")
    got = vocabulary.salient_words(counts, "label", [0, 1], min_count=2, min_lift=1.5)
    assert [(r[0], r[1], r[2]) for r in rows(got, "word", "label", "word_n", "lift")] == [("bad", 0, 2), ("good", 1, 3)]


def test_array_functions(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0], 1), ([0.0, 0.0, 0.0], 0), ([700.0, -700.0, 5.0], 1)], "s array<double>, y int")
    got = df.select(
        vx.argmax(F.col("s")).alias("top"), vx.cross_entropy(F.col("s"), F.col("y")).alias("loss"),
        vx.add(F.col("s"), vx.zeros(3)).alias("same"), vx.scale(F.col("s"), F.lit(2.0)).alias("twice"),
        vx.ratio_or_zero(F.lit(0), F.lit(0)).alias("zero"), vx.dot(F.col("s"), [1, 2, 3]).alias("dot"), "s", "y",
    ).collect()
    assert [r.top for r in got] == [1, 0, 0]
    for r in got:
        s = np.array(r.s)
        assert r.loss == pytest.approx(np.log(np.exp(s - s.max()).sum()) + s.max() - s[r.y])
        assert r.same == r.s and r.twice == [2 * v for v in r.s] and r.zero == 0.0
        assert r.dot == pytest.approx(float(s @ [1, 2, 3]))


@pytest.mark.parametrize("few", [None, 3])
def test_stored_vectors_stay_where_they_are(spark, fixture, tmp_path, few):
    texts, table, df, vec = fixture
    limits = vectors.VectorLimits(broadcast_bytes=few * (4 * DIM + 64)) if few else vectors.VectorLimits()
    vectors.store_vectors(vec, "stored_words", DIM, 3, limits, path=str(tmp_path / "words"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Spark would broadcast so small a table by itself.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vectors.mean_vectors_stored(df, "id", "text", "stored_words", DIM, limits)
        text = plan(found)
        got = {r.id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE stored_words")
    for i, words in texts.items():
        np.testing.assert_allclose(got[i].vector, expected_mean(words, table), atol=1e-9)
    if few:
        # Rare words go to the buckets; the stored side has no exchange.
        assert "Bucketed: true" in text and "SortMergeJoin" in text
        assert text.count("Exchange hashpartitioning(word") == 1


def test_encoding_by_frequent_and_rare_words(spark):
    """Frequent words are looked up in place; null and shared ids and empty texts give what a broadcast gives."""
    texts = [(i % 50 if i % 9 else None, " ".join(f"w{k * k % (i + 2)}" for k in range(i % 14)) or None) for i in range(120)]
    df = spark.createDataFrame([*texts, (900, ""), (901, "nowhere w1")], "id long, text string").repartition(3)
    vocab = spark.createDataFrame([(f"w{k}", k + 1) for k in range(0, 100, 2)], "word string, word_index long")
    made = [vocabulary.encode_fixed_length(df, "id", "text", vocab, 10, unknown_id=777, limits=JoinLimits(n)) for n in (1000, 5)]
    assert rows(made[1]) == rows(made[0])
    assert made[1].count() == df.select("id").distinct().count()
    assert "LeftAnti" in plan(made[1])


def test_partitions_of_texts_grow_with_the_texts(spark, monkeypatch):
    """What a task counts is bounded by the partition, not by the number of tasks."""
    from quillwave.operators import skew

    monkeypatch.setattr(skew, "PARTITION_CHARS", 1000)
    for n in (1000, 5000):
        df = spark.createDataFrame([(i, "some words of a text") for i in range(n)], "id long, text string")
        assert vectors.word_bags(df, "id", "text").rdd.getNumPartitions() == n * 20 // 1000


def test_rare_words_meet_texts_in_groups(spark, monkeypatch):
    """Null, shared and repeated keys, missing numbers and unknown words: the same as a broadcast gives."""
    from quillwave.operators import skew

    monkeypatch.setattr(skew, "PARTITION_CHARS", 100)
    texts = [(i % 40 if i % 9 else None, " ".join(f"w{k * k % (i + 2)}" for k in range(i % 14)) or None) for i in range(90)]
    df = spark.createDataFrame(texts, "id long, text string")
    numbers = [(f"w{k}", None if k == 4 else [float(k)] * 5 + [None if k % 3 else 2.5] * 2) for k in range(0, 60, 2)]
    vec = spark.createDataFrame([*numbers, ("w6", [1.0] * 7)], "word string, vector array<float>")
    few = vectors.VectorLimits(broadcast_bytes=2 * (4 * 7 + 64), block=4)
    want = vectors.mean_vectors(df, "id", "text", vec, 7, vectors.VectorLimits(block=4))
    got = vectors.mean_vectors(df, "id", "text", vec, 7, few)
    assert "CoGroup" in plan(got) and "CoGroup" not in plan(want)
    assert got.count() == want.count()
    for a, b in zip(rows(got, "id", "n_tokens"), rows(want, "id", "n_tokens"), strict=True):
        assert a == b
    total = {r.id: list(r.vector) for r in want.collect()}
    for r in got.collect():
        assert [x is None for x in r.vector] == [x is None for x in total[r.id]]
        assert [x for x in r.vector if x is not None] == pytest.approx([x for x in total[r.id] if x is not None])
