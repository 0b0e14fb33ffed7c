import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from quillwave.operators import labels, split
from quillwave.operators.ranking import global_rank
from quillwave.operators.skew import JoinLimits, attach_by_key

# Forces the shuffle join with slices for every key of more than 3 rows.
SLICED = JoinLimits(broadcast_rows=0)


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(1)
    data = []
    for i in range(300):
        # A third of all rows share one text.
        text = "hot text" if i % 3 == 0 else f"text {draw.randint(0, 120)}"
        data.append((i, text, draw.randint(0, 1) if draw.random() < 0.3 else 0))
    return data, spark.createDataFrame(data, "id long, text string, label int").repartition(5)


def test_profiles(labelled):
    data, df = labelled
    ones = sum(r[2] for r in data)
    assert rows(labels.class_counts(df, "label")) == [(0, 300 - ones), (1, ones)]
    assert [round(r[2], 9) for r in rows(labels.class_shares(df, "label"))] == [
        round((300 - ones) / 300, 9), round(ones / 300, 9)]
    assert [r.id for r in labels.first_rows(df, "id", 4).collect()] == [0, 1, 2, 3]


def test_duplicates(labelled):
    data, df = labelled
    seen, expected = set(), []
    for i, text, _ in data:
        if text in seen:
            expected.append(i)
        seen.add(text)
    got = labels.duplicate_rows(df, "id", "text")
    assert sorted(r.id for r in got.collect()) == expected


@pytest.mark.parametrize("limits", [JoinLimits(), SLICED])
def test_conflicts(labelled, limits):
    data, df = labelled
    groups = {}
    for i, text, label in data:
        groups.setdefault(text, []).append((i, label))
    expected = sorted(
        (members[0][0], i, label, len(members), members[0][1])
        for members in groups.values()
        if len({m[1] for m in members}) > 1
        for i, label in members
    )
    got = labels.label_conflicts(df, "id", "text", "label", limits)
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_corrections(spark):
    df = spark.createDataFrame([(6112, 0), (2, 1)], "id int, target int")
    fixes = spark.createDataFrame([(2, 0)], "id int, new int")
    assert rows(labels.apply_corrections(df, fixes, "id", "target", "new")) == [(2, 0), (6112, 0)]
    assert rows(labels.set_label(df, "id", 6112, "target", 1)) == [(2, 1), (6112, 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_sliced_join_equals_broadcast_join(spark, how):
    facts = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    table = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    usual = attach_by_key(facts, table, ["k"], how=how)
    sliced = attach_by_key(facts, table, ["k"], how=how, limits=SLICED)
    assert "BroadcastHashJoin" in plan(usual)
    assert rows(usual, "id", "k", "v") == rows(sliced, "id", "k", "v")


def test_global_rank_over_many_partitions(spark):
    draw = random.Random(5)
    data = [(draw.randint(0, 9), i) for i in range(1000)]
    df = spark.createDataFrame(data, "a int, b int").repartition(7)
    got = global_rank(df, [F.col("a").desc(), F.col("b")], "place")
    expected = {(a, b): i for i, (a, b) in enumerate(sorted(data, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r.a, r.b): r.place for r in got.collect()} == expected


@pytest.mark.parametrize("n", [1, 2, 19, 200])
@pytest.mark.parametrize("fraction,up", [(0.1, True), (0.99, False)])
@pytest.mark.parametrize("digits", [1, 4])
def test_exact_split(spark, n, fraction, up, digits):
    df = spark.range(n).repartition(3)
    got = split.exact_split(df, "id", fraction, seed=9, round_up=up, digits=digits, few=2)
    first = {r.id for r in got.collect() if r.in_first}
    wanted = math.ceil(fraction * n) if up else math.floor(fraction * n)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    assert first == set(order[:wanted])
    assert got.count() == n


def test_split_does_not_shuffle_rows(spark):
    got = split.exact_split(spark.range(100), "id", 0.1)
    assert "Exchange" not in plan(got)
    a, b = split.fast_split(spark.range(1000), 0.9)
    assert a.intersect(b).count() == 0 and a.count() + b.count() == 1000


def test_shuffled_is_repeatable(spark):
    ids = [r.id for r in split.shuffled(spark.range(50), "id").collect()]
    assert ids == sorted(range(50), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())


def test_oversample_counts(spark):
    df = spark.createDataFrame([(i, i % 6) for i in range(60)], "id int, label int")
    got = split.oversample(df, "label", [3, 1, 0, 1, 3])
    # Class 5 is outside the list and gets no copies.
    assert got.count() == sum(1 + w for w in [3, 1, 0, 1, 3, 0]) * 10
    assert got.where("copy = 0").count() == 60
    assert "Exchange" not in plan(got)


def test_split_of_null_ids_is_an_error(spark):
    df = spark.createDataFrame([(1,), (None,)], "id long")
    with pytest.raises(ValueError, match="NULL"):
        split.exact_split(df, "id", 0.5)


def test_negative_weights_add_no_copies(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id int, label int")
    assert rows(split.oversample(df, "label", [-3, 1]), "id", "copy") == [(1, 0), (2, 0), (2, 1)]
