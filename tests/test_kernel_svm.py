import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators import kernel_svm
from quillwave.operators.kernel_svm import CosineFeatures


def ring_rows(n=360):
    draw = np.random.default_rng(4)
    label = np.arange(n) % 3
    angle = draw.uniform(0, 2 * np.pi, n)
    radius = 0.5 + label + draw.normal(scale=0.12, size=n)
    return [(i, [float(r * np.cos(a)), float(r * np.sin(a))], int(c) + 1) for i, (r, a, c) in enumerate(zip(radius, angle, label))]


@pytest.fixture(scope="module")
def rings(spark):
    odd = [(9000, None, 1), (9001, [0.0, 0.0], None)]
    return spark.createDataFrame(ring_rows() + odd, "id long, vector array<double>, label int").cache()


@pytest.fixture(scope="module")
def model(rings):
    return kernel_svm.fit(rings.where("id % 4 <> 0"), 2, n_features=200, gamma=1.0, cost=10.0, max_iter=25)


def share(scored):
    held = scored.where("id % 4 = 0 AND label IS NOT NULL")
    return held.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def test_kernel_beats_linear_on_rings(rings, model):
    linear = kernel_svm.fit(rings.where("id % 4 <> 0"), 2, kernel=False, max_iter=25)
    curved = share(kernel_svm.predicted(model, rings, "vector", "id", "label"))
    straight = share(kernel_svm.predicted(linear, rings, "vector", "id", "label"))
    assert [(m.first, m.second) for m in model.machines] == [(1, 2), (1, 3), (2, 3)]
    assert curved > 0.9 and curved > straight + 0.2


def test_votes_by_sql_from_written_scores(spark, rings, model, folder):
    scores = kernel_svm.pair_scores(model, rings, "vector", "id")
    scores.write.parquet(f"{folder}/scores")
    got = rows(kernel_svm.votes(spark.read.parquet(f"{folder}/scores"), "id"), "id", "prediction", "votes")
    want = duckdb.sql(f"""
        WITH w AS (SELECT id, CASE WHEN score > 0 THEN first ELSE second END AS c FROM '{folder}/scores/*.parquet'),
             n AS (SELECT id, c, count(*) AS votes FROM w GROUP BY ALL)
        SELECT id, c, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, c) AS r FROM n) WHERE r = 1""").fetchall()
    assert got == sorted(want, key=lambda r: tuple((False, str(v)) for v in r))
    assert len(got) == 361
    # Counting inside the tasks gives the same, and no prediction without a vector.
    direct = rows(kernel_svm.predicted(model, rings, "vector", "id"))
    assert [r for r in direct if r[1] is not None] == [r[:2] for r in got]
    assert (9000, None) in direct


def test_features_approach_the_kernel(spark):
    df = spark.createDataFrame([([0.1, 0.4],), ([0.3, -0.2],)], "v array<double>").repartition(2)
    z = np.array([r.z for r in df.select(CosineFeatures(2, 4000, 0.7).of(F.col("v")).alias("z")).collect()])
    assert z[0] @ z[1] == pytest.approx(np.exp(-0.7 * (0.2**2 + 0.6**2)), abs=0.05)


def test_save_load_and_scale(spark, rings, model, folder):
    model.save(spark, f"{folder}/m")
    assert kernel_svm.PairModel.load(spark, f"{folder}/m") == model
    values = [v for _, row, _ in ring_rows() for v in row] + [0.0, 0.0]
    assert kernel_svm.scale_gamma(rings.where("vector IS NOT NULL"), "vector", 2) == pytest.approx(1 / (2 * np.var(values)))


def test_ties_take_the_smaller_class(spark):
    cycle = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 0, 2, -1.0)], "id int, first int, second int, score double")
    assert rows(kernel_svm.votes(cycle, "id")) == [(1, 0, 1)]
