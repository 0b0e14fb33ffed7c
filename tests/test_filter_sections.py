import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.operators import filters
from quillwave.operators.filters import Cascade, Recursion, filter_recordings, forward_backward


def lowpass(order, cutoff):
    """Second-order sections of a maximally flat low-pass (cutoff as share of the sampling rate)."""
    k = np.tan(np.pi * cutoff)
    out = []
    for i in range(order // 2):
        damp = 2 * np.sin(np.pi * (2 * i + 1) / (2 * order))
        scale = 1 + damp * k + k * k
        out.append(([k * k / scale, 2 * k * k / scale, k * k / scale], [1.0, 2 * (k * k - 1) / scale, (1 - damp * k + k * k) / scale]))
    return out


def expanded(sections):
    b, a = np.array([1.0]), np.array([1.0])
    for x, y in sections:
        b, a = np.convolve(b, x), np.convolve(a, y)
    return b, a


def direct(b, a, x, memory):
    """The difference equation as it is written."""
    b, a = np.asarray(b) / a[0], np.asarray(a) / a[0]
    memory, out = np.append(np.array(memory, float), 0.0), []
    for v in x:
        y = b[0] * v + memory[0]
        memory[:-1] = memory[1:] + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out), memory[:-1]


@pytest.mark.parametrize("b,a", [([0.2, 0.3, 0.2], [1.0, -0.4, 0.1]), ([1.0, 0.5], [2.0, 0.7]), ([0.1, 0.2, 0.3, 0.1], [1.0, -0.2, 0.3, -0.1])])
def test_blocks_equal_single_steps(b, a):
    draw = np.random.default_rng(0)
    rule = Recursion(b, a)
    rows = [draw.normal(size=n) for n in (0, 1, 31, 32, 33, 64, 200, 1000)]
    memory = draw.normal(size=(len(rows), len(rule.steady)))
    got, left = rule.run(rows, memory)
    for row, start, done, after in zip(rows, memory, got, left):
        want, end = direct(b, a, row, start)
        np.testing.assert_allclose(done, want, atol=1e-10)
        np.testing.assert_allclose(after, end, atol=1e-10)


def test_cascade_memory():
    draw = np.random.default_rng(1)
    rule = Cascade(lowpass(6, 0.1))
    x = draw.normal(size=300)
    whole, end = rule.run([x], np.zeros((1, 6)))
    first, middle = rule.run([x[:130]], np.zeros((1, 6)))
    second, last = rule.run([x[130:]], middle)
    np.testing.assert_allclose(np.concatenate([first[0], second[0]]), whole[0], atol=1e-12)
    np.testing.assert_allclose(last, end, atol=1e-12)
    # What is left is linear: silence from the middle, plus the rest from nothing.
    _, own = rule.run([x[130:]], np.zeros((1, 6)))
    np.testing.assert_allclose(rule.skip(middle[0], 170) + own[0], end[0], atol=1e-9)
    # A constant passes from the steady memory unchanged.
    flat, _ = rule.run([np.ones(50)], rule.steady[None])
    np.testing.assert_allclose(flat[0], 1, atol=1e-9)


def test_order_eight_is_stable_in_sections():
    sections = lowpass(8, 0.002)
    x = np.sin(np.arange(6000) * 2 * np.pi * 0.0005) + np.random.default_rng(2).normal(scale=0.1, size=6000)
    good = forward_backward([x], sections, None)[0]
    assert np.abs(good - np.sin(np.arange(6000) * 2 * np.pi * 0.0005))[500:-500].max() < 0.1
    with np.errstate(all="ignore"):
        try:
            bad = forward_backward([x], *expanded(sections))[0]
            off = np.abs(bad - good).max()
        except np.linalg.LinAlgError:
            off = np.inf
    assert not off < 1e-3
    # At low order both forms agree.
    mild = lowpass(4, 0.1)
    pad = Cascade(mild).default_pad
    np.testing.assert_allclose(forward_backward([x], mild, None)[0], forward_backward([x], *expanded(mild), pad=pad)[0], atol=1e-9)


@pytest.mark.parametrize("size", [17, 100, 5000])
def test_chunked_recordings_equal_one_pass(spark, size):
    draw = np.random.default_rng(5)
    series = {k: draw.normal(size=n).cumsum() for k, n in ((1, 700), (2, 1), (3, 40))}
    flat = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(flat, "k int, t int, v double").repartition(4)
    sections = lowpass(8, 0.05)
    done = filter_recordings(df, ["k"], "t", "v", F.floor(F.col("t") / size), sections, None)
    got = {(r.k, r.t): r.filtered for r in done.collect()}
    for k, x in series.items():
        want = forward_backward([x], sections, None)[0]
        np.testing.assert_allclose([got[k, t] for t in range(len(x))], want, atol=1e-9)


def test_rule_choice():
    assert isinstance(filters._rule([([1.0], [1.0])], None), Cascade)
