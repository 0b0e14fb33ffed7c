import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators import trials as tr
from quillwave.operators.filters import filter_recordings, forward_backward, gather_series, zero_phase
from quillwave.operators.skew import JoinLimits
from quillwave.plans.motor_imagery import csp_features

SLICED = JoinLimits(broadcast_rows=0)


@pytest.fixture(scope="module")
def signal(spark):
    draw = np.random.default_rng(0)
    mix = {0: draw.normal(size=(4, 4)), 1: draw.normal(size=(4, 4)) * [[3], [1], [1], [0.2]]}
    data = {t: (t % 2, mix[t % 2] @ draw.normal(size=(4, 30)) + [[1], [2], [3], [4]]) for t in range(12)}
    flat = [(t, c, s, x[:, s].tolist()) for t, (c, x) in data.items() for s in range(30)]
    df = spark.createDataFrame(flat, "trial int, class int, sample int, values array<double>").repartition(5)
    return data, df


def offsets(data, name):
    return np.mean([x.mean(axis=1) for c, x in data.values() if c == name], axis=0)


def test_wide_and_long(signal):
    _, df = signal
    back = tr.to_wide(tr.to_long(df), ["trial", "class", "sample"])
    assert rows(back, "trial", "class", "sample", "values") == rows(df, "trial", "class", "sample", "values")


@pytest.mark.parametrize("limits", [JoinLimits(), SLICED])
def test_zscore_and_centre(signal, limits):
    data, df = signal
    long = tr.to_long(df)
    got = {(r.trial, r.channel, r.sample): r.z for r in
           tr.zscore(long, ["trial", "channel"], "value", limits=limits).collect()}
    for t, (_, x) in data.items():
        z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
        np.testing.assert_allclose([[got[t, c, s] for s in range(30)] for c in range(4)], z, atol=1e-9)
    for r in tr.centre_channels(df, ["trial"], "class", limits).collect():
        c, x = data[r.trial]
        np.testing.assert_allclose(r["values"], x[:, r.sample] - offsets(data, c), atol=1e-9)


def test_zscore_of_constant_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, v double")
    assert [r.z for r in tr.zscore(df, ["k"], "v").collect()] == [None, None]


def covariance(data, name):
    own = [x - offsets(data, name)[:, None] for c, x in data.values() if c == name]
    total = sum(x @ x.T for x in own)
    return total / np.trace(total)


def test_covariance(signal):
    data, df = signal
    got = np.zeros((2, 4, 4))
    for r in tr.class_covariance(tr.centre_channels(df, ["trial"], "class"), "class").collect():
        got[r["class"], r.i, r.j] = r.value
    np.testing.assert_allclose(got, [covariance(data, 0), covariance(data, 1)], atol=1e-12)


def test_covariance_with_string_class(spark):
    df = spark.createDataFrame([("T1", [1.0, 2.0]), ("T2", [0.0, 3.0])], "class string, values array<double>")
    got = rows(tr.class_covariance(df, "class"))
    assert got[0] == ("T1", 0, 0, pytest.approx(0.2)) and len(got) == 8


def test_csp_against_direct_computation(signal):
    data, df = signal
    num = 1
    a, b = covariance(data, 0), covariance(data, 1)
    # Generalised problem b v = s a v, scaled so that v' (a + b) v = 1.
    strength, axes = np.linalg.eig(np.linalg.solve(a, b))
    order = np.argsort(strength)
    chosen = [order[-1], order[0]]
    w = np.array([axes[:, k] / np.sqrt(axes[:, k] @ (a + b) @ axes[:, k]) for k in chosen])
    got = {r.trial: r.features for r in csp_features(df, ["trial"], "class", (0, 1), num).collect()}
    for t, (_, x) in data.items():
        energy = ((w @ x) ** 2).sum(axis=1)
        np.testing.assert_allclose(got[t], np.log(energy / energy.sum()), atol=1e-8)


def test_task_classes_and_exclusion(spark):
    assert tr.task_classes(spark).count() == 24
    df = spark.createDataFrame([(3, "T1"), (14, "T2"), (3, "T0"), (2, "T1")], "run int, marker string")
    assert rows(tr.with_task_class(df), "run", "task") == [(14, "feet"), (3, "left")]
    assert tr.exclude_keys(spark.range(87, 93), "id").count() == 4


def plain_filter(x, b, a, rest):
    """One difference equation, one number at a time."""
    out, memory = [], [m * x[0] for m in rest]
    for value in x:
        y = b[0] * value + memory[0]
        memory = [
            (memory[k + 1] if k + 1 < len(memory) else 0.0) + b[k + 1] * value - a[k + 1] * y for k in range(len(memory))
        ]
        out.append(y)
    return out


def test_filter(spark):
    b, a = [0.2, 0.3, 0.2], [1.0, -0.4, 0.1]
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3, 40))
    # Direct: extend by odd reflection, filter forward, then backward.
    gain = sum(b) / sum(a)
    rest = [gain - b[0], b[2] - a[2] * gain]
    for series, got in zip(x, forward_backward(list(x), b, a)):
        pad = 9
        ext = np.r_[2 * series[0] - series[pad:0:-1], series, 2 * series[-1] - series[-2 : -2 - pad : -1]]
        once = plain_filter(ext, b, a, rest)[::-1]
        np.testing.assert_allclose(got, plain_filter(once, b, a, rest)[::-1][pad:-pad], atol=1e-10)
    np.testing.assert_allclose(forward_backward([np.ones(9)], b, a), np.full((1, 9), gain**2), atol=1e-12)

    flat = [(i, s, float(x[i, s])) for i in range(3) for s in range(40)] + [(3, 0, 1.0), (4, 0, 2.0), (4, 1, 2.0)]
    df = spark.createDataFrame(flat, "k int, sample int, value double").repartition(4)
    got = gather_series(df, ["k"]).withColumn("series", zero_phase(F.col("series"), b, a))
    series = {r.k: r.series for r in got.collect()}
    np.testing.assert_allclose([series[i] for i in range(3)], forward_backward(list(x), b, a), atol=1e-12)
    assert series[4] == pytest.approx([2 * gain**2] * 2)


@pytest.mark.parametrize("pad", [None, 0, 30])
@pytest.mark.parametrize("size", [1, 4, 1000])
def test_long_series_in_chunks(spark, size, pad):
    b, a = [0.1, 0.0, -0.1], [1.0, -1.6, 0.8]
    draw = np.random.default_rng(3)
    series = {k: draw.normal(size=n) for k, n in enumerate((90, 1, 2, 17))}
    # Gaps in time: chunks have different lengths.
    times = {k: np.cumsum(draw.integers(1, 4, size=len(x))) for k, x in series.items()}
    flat = [(k, int(t), float(v)) for k, x in series.items() for t, v in zip(times[k], x)]
    df = spark.createDataFrame(flat, "k int, t int, v double").repartition(4)
    got = {}
    for r in filter_recordings(df, ["k"], "t", "v", F.floor(F.col("t") / size), b, a, pad=pad).orderBy("t").collect():
        got.setdefault(r.k, []).append(r.filtered)
    for k, x in series.items():
        np.testing.assert_allclose(got[k], forward_backward([x], b, a, pad)[0], atol=1e-9)


@pytest.mark.parametrize("limits", [JoinLimits(), SLICED])
def test_null_keys_keep_their_rows(spark, limits):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, None, 9.0)], "id int, k string, v double")
    assert rows(tr.zscore(df, ["k"], "v", limits=limits), "id", "z") == [(1, -1.0), (2, 1.0), (3, -1.0), (4, 1.0)]
    two = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [4.0, 6.0])], "trial int, c string, values array<double>")
    got = rows(tr.centre_channels(two, ["trial"], "c", limits), "trial", "values")
    assert got == [(1, [0.0, 0.0]), (2, [0.0, 0.0])]
