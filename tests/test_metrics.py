import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators import metrics


def test_accuracy_and_loss(spark):
    df = spark.createDataFrame([([1.0, 3.0], 1), ([0.0, 0.0], 1)], "s array<double>, y int")
    loss = metrics.mean_cross_entropy(df, "s", "y").first()
    assert loss.n == 2 and loss.loss == pytest.approx((0.126928 + 0.693147) / 2, abs=1e-6)
    done = df.withColumn("p", F.lit(1))
    assert metrics.accuracy(done, "p", "y").first().accuracy == 1.0


def test_epoch_log_and_best(spark):
    log = [("a", 1, 0.5, 2, 1), ("a", 1, 0.7, 2, 2), ("a", 2, 0.6, 2, 2), ("a", 2, 0.6, 1, 0), ("a", 3, 0.9, 2, 2)]
    batches = spark.createDataFrame(log, "run string, epoch int, batch_loss double, batch_rows int, batch_correct int")
    per_epoch = metrics.epoch_log(batches, ["run", "epoch"])
    got = {r.epoch: r for r in per_epoch.collect()}
    assert got[1].loss_per_row == pytest.approx(0.3) and got[1].mean_loss == pytest.approx(0.6)
    assert got[2].accuracy == pytest.approx(2 / 3) and got[2].n_rows == 3
    named = per_epoch.withColumn("model", F.concat(F.lit("m"), F.col("epoch"))).withColumn("loss", F.round("mean_loss", 6))
    # Epochs 1 and 2 tie: the first one stays.
    assert rows(metrics.best_checkpoint(named, ["run"], "model", "loss", "epoch"), "model", "epoch") == [("m1", 1)]


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_running_best(spark, size):
    draw = random.Random(4)
    data = [(run, epoch, float(draw.randint(0, 30))) for run in range(3) for epoch in range(40) if draw.random() < 0.8]
    df = spark.createDataFrame(data, "run int, epoch int, loss double").repartition(4)
    got = metrics.running_best(df, ["run"], "epoch", "loss", F.floor(F.col("epoch") / size))
    seen = {(r.run, r.epoch): (r.best_before, r.improved) for r in got.collect()}
    best = {}
    for run, epoch, loss in data:
        before = best.get(run)
        assert seen[run, epoch] == (before, before is None or loss < before)
        best[run] = loss if before is None else min(before, loss)
