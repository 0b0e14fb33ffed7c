import random

import pytest
from pyspark.sql import functions as F

from conftest import plan
from quillwave.operators.sequences import first_of_runs, label_samples, mark_runs, run_lengths
from quillwave.plans.motor_imagery import segment


def recordings(seed, n=120):
    """Recording 0 holds most rows."""
    draw = random.Random(seed)
    out = []
    for rec in (0, 0, 0, 1, 2):
        t = 1000 * len(out)
        for _ in range(draw.randint(1, n)):
            t += draw.choice([1, 1, 1, 7, 60])
            out.append((rec, float(t)))
    return sorted(set(out))


@pytest.mark.parametrize("size", [1, 5, 100, 10**6])
def test_label_samples(spark, size):
    draw = random.Random(size)
    samples = recordings(1)
    notes = [(rec, t + draw.choice([0.0, 0.5]), draw.choice(["T0", "T1", None])) for rec, t in samples if draw.random() < 0.2]
    got = label_samples(
        spark.createDataFrame(samples, "rec int, t double").repartition(3),
        spark.createDataFrame(notes, "rec int, onset double, code string"),
        ["rec"], time_col="t", onset_col="onset", code_col="code", chunk=lambda t: F.floor(t / size),
    )
    seen = {(r.rec, r.t): r.code for r in got.collect()}
    assert len(seen) == len(samples)
    for rec, t in samples:
        earlier = [(o, c) for r, o, c in notes if r == rec and o <= t]
        assert seen[rec, t] == (max(earlier, key=lambda p: p[0])[1] if earlier else None)


def test_samples_past_the_last_end_are_dropped(spark):
    samples = spark.createDataFrame([(1, float(t)) for t in range(10)] + [(2, 0.0)], "rec int, t double")
    notes = spark.createDataFrame([(1, 0.0, 50.0, "a"), (1, 4.0, 7.0, "b")], "rec int, onset double, until double, code string")
    got = label_samples(samples, notes, ["rec"], time_col="t", onset_col="onset", code_col="code",
                        chunk=lambda t: F.floor(t / 3), end_col="until")
    assert sorted((r.rec, r.t, r.code) for r in got.collect()) == (
        [(1, float(t), "a") for t in range(4)] + [(1, float(t), "b") for t in range(4, 7)] + [(2, 0.0, None)]
    )


@pytest.mark.parametrize("size", [1, 3, 50, 10**6])
def test_runs(spark, size):
    draw = random.Random(size + 1)
    marker, data = "T0", []
    for rec, t in recordings(2):
        if draw.random() < 0.15:
            marker = draw.choice(["T0", "T1", "T2", None])
        data.append((rec, t, marker))
    df = spark.createDataFrame(data, "rec int, t double, marker string").repartition(5)
    marked = mark_runs(df, ["rec"], ["t"], "marker", F.floor(F.col("t") / size))

    expected, starts = {}, {}
    for i, (rec, t, m) in enumerate(data):
        first = i == 0 or data[i - 1][0] != rec
        position = 1 if first else position + 1
        if first or data[i - 1][2] != m:
            start = position
        expected[rec, t] = (position, start)
        starts.setdefault((rec, start), []).append((rec, t, m))
    assert {(r.rec, r.t): (r.position, r.run_start) for r in marked.collect()} == expected
    assert {(r.rec, r.run_start): (r.marker, r.n) for r in run_lengths(marked, ["rec"], "marker").collect()} == {
        k: (v[0][2], len(v)) for k, v in starts.items()
    }
    for start, end in ((0, 4), (2, 5)):
        cut = {(r.rec, r.run_start, r.t, r.sample) for r in first_of_runs(marked, ["rec"], start, end).collect()}
        assert cut == {
            (rec, s, t, at - start)
            for (rec, s), members in starts.items()
            if len(members) >= end - start
            for at, (_, t, _) in enumerate(members)
            if start <= at < end
        }


def test_runs_shuffle_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("rec"), F.col("id").alias("t"), F.lit("a").alias("m"))
    marked = mark_runs(df, ["rec"], ["t"], "m", F.floor(F.col("t") / 10))
    marked.collect()
    text = plan(marked)
    assert "ReusedExchange" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("size", [0.5, 2, 10**5])
def test_segment_end_to_end(spark, size):
    rate, samples = 4, []
    for subject, run in ((1, 3), (1, 5), (88, 3)):
        samples += [(subject, run, round(i / rate, 5), [float(i), -float(i)]) for i in range(60)]
    notes = []
    for subject, run in ((1, 3), (1, 5), (88, 3)):
        notes += [(subject, run, 0.0, 2.0, "T0"), (subject, run, 2.0, 4.0, "T1"), (subject, run, 6.0, 1.0, "T2"),
                  (subject, run, 7.0, 3.0, "T0"), (subject, run, 10.0, 4.0, "T2")]
    got = segment(
        spark.createDataFrame(samples, "subject int, run int, t double, values array<double>"),
        spark.createDataFrame(notes, "subject int, run int, onset double, duration double, code string"),
        time_range=(0, 2), sample_rate=rate, chunk=lambda t: F.floor(t / size),
    ).collect()
    # The T2 at 6 s lasts 4 samples only; subject 88 is excluded.
    trials = {}
    for r in sorted(got, key=lambda r: r.sample):
        trials.setdefault((r.subject, r.run, r.trial, r.task), []).append(r["values"][0])
    assert trials == {
        (1, 3, 9, "left"): [float(i) for i in range(8, 16)],
        (1, 3, 41, "right"): [float(i) for i in range(40, 48)],
        (1, 5, 9, "fist"): [float(i) for i in range(8, 16)],
        (1, 5, 41, "feet"): [float(i) for i in range(40, 48)],
    }
