import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators import training
from quillwave.operators.training import Network, Plan, State


def rings(n, seed=0):
    draw = np.random.default_rng(seed)
    radius = 1 + np.arange(n) % 2 * 1.5
    angle = draw.uniform(0, 2 * np.pi, n)
    points = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1) + draw.normal(scale=0.1, size=(n, 2))
    return [(i, points[i].tolist(), i % 2, i % 5 == 0) for i in range(n)]


SCHEMA = "id long, vector array<double>, label int, is_dev boolean"


@pytest.fixture(scope="module")
def points(spark):
    odd = [(1000, None, 1, False), (1001, [0.0, 0.0], None, True)]
    return spark.createDataFrame(rings(240) + odd, SCHEMA)


def by_hand(spark, points, network, plan, epochs, weights):
    """The same steps in one process: each worker's rows in the order of the epoch."""
    train = points.where("NOT is_dev AND vector IS NOT NULL").repartition(plan.workers, "id").withColumn("w", F.spark_partition_id())
    state = State.start(weights)

    def summed(held, some):
        x, y = np.array([r.vector for r in some]), np.array([r.label for r in some])
        return network.gradient(held.weights, x, y, np.random.default_rng(0))

    for epoch in range(1, epochs + 1):
        ordered = train.withColumn("o", F.xxhash64(F.lit(plan.seed), F.lit(epoch), "id")).collect()
        own = [sorted((r for r in ordered if r.w == w), key=lambda r: (r.o, r.id)) for w in range(plan.workers)]
        steps = [[held[k : k + plan.rows] for k in range(0, len(held), plan.rows)] for held in own]
        for at in range(0, max(map(len, steps)), plan.local_steps):
            if plan.local_steps == 1:
                some = [held[at] for held in steps if at < len(held)]
                state.update(sum(summed(state, s) for s in some) / sum(map(len, some)), plan.rate)
                continue
            after, seen = [], []
            for held in steps:
                mine = State(state.weights, state.first, state.second, state.steps)
                for s in held[at : at + plan.local_steps]:
                    mine.update(summed(mine, s) / len(s), plan.rate)
                after.append(mine)
                seen.append(sum(map(len, held[at : at + plan.local_steps])))
            mean = [sum(n * getattr(m, f) for n, m in zip(seen, after)) / sum(seen) for f in ("weights", "first", "second")]
            state = State(*mean, max(m.steps for m in after))
    return state


@pytest.mark.parametrize("plan", [Plan(75, 3, 1, 0.01, 5), Plan(10, 3, 4, 0.01, 5)])
def test_epochs_equal_one_process(spark, points, folder, plan):
    network = Network((2, 6, 5, 2))
    weights = network.initial(3)
    done = training.train_epochs(
        points, network, folder, epochs=2, batch=plan.batch, workers=3, local_steps=plan.local_steps, rate=0.01, seed=5, weights=weights
    )
    want = by_hand(spark, points, network, plan, 2, weights)
    got = training.stored_state(spark, folder, 2)
    assert got.steps == want.steps
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-9, atol=1e-12)
    log = {(r.epoch, r.part): r for r in done.log.collect()}
    assert sorted(log) == [(e, p) for e in (1, 2) for p in ("dev", "train")]
    for part, dev in (("dev", True), ("train", False)):
        held = [r for r in rings(240) if r[3] == dev]
        scores = network.scores(want.weights, np.array([r[1] for r in held]))
        labels = np.array([r[2] for r in held])
        last = log[2, part]
        assert last.n == len(held)
        assert last.loss == pytest.approx(training.losses(scores, labels).mean(), rel=1e-9)
        assert last.accuracy == pytest.approx((scores.argmax(axis=1) == labels).mean())


def test_gradient_by_differences():
    network = Network((3, 4, 5, 3))
    draw = np.random.default_rng(1)
    flat, x, y = network.initial(2), draw.normal(size=(7, 3)), draw.integers(0, 3, 7)
    got = network.gradient(flat, x, y, draw)
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (training.losses(network.scores(flat + s, x), y).sum() for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_learns_rings_keeps_the_best_and_goes_on(spark, points, folder):
    network = Network((2, 16, 16, 2), dropout=0.01)
    first = training.train_epochs(points, network, folder, epochs=3, batch=8, workers=2, rate=0.02, local_steps=12)
    stored = training.stored_state(spark, folder, 3)
    # A later call goes on after the epochs that are there.
    done = training.train_epochs(points, network, folder, epochs=12, batch=8, workers=2, rate=0.02, local_steps=12)
    assert np.array_equal(stored.weights, training.stored_state(spark, folder, 3).weights)
    assert rows(first.log) == rows(done.log.where("epoch <= 3"))
    dev = {r.epoch: r.loss for r in done.log.where("part = 'dev'").collect()}
    assert done.best_epoch == min(dev, key=lambda e: (dev[e], e))
    scored = training.predicted(points, done, "vector", "id", "label", "is_dev")
    right = scored.where("is_dev AND label IS NOT NULL").agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert right > 0.9
    assert scored.where("id = 1000").first().prediction is None


def test_more_workers_than_rows_and_no_dev_rows(spark, folder):
    few = spark.createDataFrame([(1, [1.0, 0.0], 0, False), (2, [0.0, 1.0], 1, False)], SCHEMA)
    done = training.train_epochs(few, Network((2, 2)), folder, epochs=1, batch=8, workers=4, rate=0.1, local_steps=2)
    assert [(r.part, r.n) for r in done.log.collect()] == [("train", 2)]


def test_message_size_is_checked(points, folder):
    with pytest.raises(ValueError, match="fewer workers"):
        training.train_epochs(points, Network((2, 4000, 4000, 2)), folder, workers=8, most_message_mb=100)


def test_no_exchange_in_an_epoch(spark, points):
    laid = points.where("vector IS NOT NULL").drop("is_dev").repartition(2, "id").checkpoint()
    network = Network((2, 2))
    text = training._epoch(laid, network, State.start(network.initial(0)), 1, Plan(8, 2, 1, 0.1, 0), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
