import numpy as np
import pytest

from quillwave.operators import joint_patterns as jp
from quillwave.operators.trials import log_variance, project, spatial_patterns
from quillwave.plans import motor_imagery
from pyspark.sql import functions as F


def covariance(draw, n):
    held = draw.normal(size=(n, 3 * n))
    held = held @ held.T
    return held / np.trace(held)


def test_exact_where_axes_are_shared():
    draw = np.random.default_rng(2)
    axes, _ = np.linalg.qr(draw.normal(size=(5, 5)))
    matrices = np.array([axes @ np.diag(draw.uniform(1, 5, 5)) @ axes.T for _ in range(4)])
    found, energies = jp.joint_axes(matrices)
    assert energies[-1] < 1e-18 * energies[0]
    np.testing.assert_allclose(np.abs(found.T @ axes).max(axis=1), 1, atol=1e-9)


def test_energy_falls_each_sweep():
    draw = np.random.default_rng(3)
    found, energies = jp.joint_axes(np.array([covariance(draw, 8) for _ in range(4)]))
    assert all(after <= before * (1 + 1e-12) for before, after in zip(energies, energies[1:]))
    assert energies[-1] < energies[0] and len(energies) < 50
    np.testing.assert_allclose(found.T @ found, np.eye(8), atol=1e-12)


def test_repair_of_tiny_variances():
    np.testing.assert_allclose(jp.repaired(np.array([1e-20, 1.0, 2.0])), [1.0, 1.0, 2.0])
    flat = np.diag([0.0, 1.0, 3.0])
    assert jp.whitening(flat).shape == (2, 3)
    whole = jp.whitening(flat, 1e-18)
    np.testing.assert_allclose(np.sort(np.diag(whole @ flat @ whole.T)), [0, 1, 1], atol=1e-12)


@pytest.fixture(scope="module")
def trials(spark):
    draw = np.random.default_rng(7)
    mixing = draw.normal(size=(5, 5))
    rows = []
    for trial in range(48):
        # Each class is loud in a source of its own.
        loud = np.ones(5)
        loud[trial % 4] = 6
        for sample in range(30):
            rows.append((trial, trial % 4, sample, (mixing @ (loud * draw.normal(size=5))).tolist()))
    return spark.createDataFrame(rows, "trial int, class int, sample int, values array<double>").cache()


def test_two_classes_equal_the_two_class_result(trials):
    two = trials.where("class < 2")
    want = np.array(spatial_patterns(two, ["trial"], "class", (0, 1), 2))
    got = np.array(jp.joint_patterns(two, ["trial"], "class", (0, 1), 2))
    # The same patterns, up to order and sign.
    match = np.abs(got / np.linalg.norm(got, axis=1)[:, None] @ (want / np.linalg.norm(want, axis=1)[:, None]).T)
    np.testing.assert_allclose(match.max(axis=1), 1, atol=1e-7)
    assert sorted(match.argmax(axis=1)) == [0, 1, 2, 3]
    scale = [np.linalg.norm(want[j]) for j in match.argmax(axis=1)]
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), scale, rtol=1e-7)


def test_four_classes_are_told_apart(trials):
    features = motor_imagery.csp_features(trials, ["trial"], "class", (0, 1, 2, 3), 1)
    held = [(r["class"], np.array(r.features)) for r in features.collect()]
    assert all(len(f) == 4 for _, f in held)
    # The loudest feature of a trial is that of its class.
    assert np.mean([int(f.argmax()) == c for c, f in held]) > 0.95


def test_absent_class(trials):
    with pytest.raises(ValueError, match="no variance"):
        jp.joint_patterns(trials, ["trial"], "class", (0, 9), 1)
