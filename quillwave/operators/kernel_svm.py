"""Support vector machine with a Gaussian kernel, one machine for each pair of classes.

The kernel exp(-gamma * |x - y|^2) is replaced by inner products of random
cosine features (Rahimi and Recht, 2007), so that a machine is a linear one
that Spark fits. Each pair of classes has a machine fitted on the rows of both
alone. A row's class is the one with most votes over all machines, the smaller
class on ties.

Defined results: rows without a vector or label take no part in the fit; a row
without a vector has no pair scores and no prediction. A pair with rows of one
class only always votes for that class; a pair without rows has no machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.session import settle


@dataclass(frozen=True)
class CosineFeatures:
    """Random directions and shifts, drawn from ``seed`` wherever they are needed."""

    dim: int
    n_features: int
    gamma: float
    seed: int = 42

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        directions = draw.normal(scale=np.sqrt(2 * self.gamma), size=(self.dim, self.n_features))
        return directions, draw.uniform(0, 2 * np.pi, size=self.n_features)

    def of(self, vector: Column) -> Column:
        """Features of a vector column; drawn once per task."""

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            directions, shifts = self.drawn()
            for batch in batches:
                block = np.array(batch.tolist(), dtype=float).reshape(len(batch), self.dim)
                yield pd.Series(list(np.sqrt(2.0 / self.n_features) * np.cos(block @ directions + shifts)))

        return run(vector)


def scale_gamma(df: DataFrame, vector_col: str, dim: int) -> float:
    """1 / (dimensions * variance of all numbers), 1 / dimensions where nothing varies."""
    row = df.select(F.explode(vector_col).alias("v")).agg(F.var_pop(F.col("v").cast("double")).alias("v")).first()
    return 1.0 / (dim * row["v"]) if row["v"] else 1.0 / dim


@dataclass(frozen=True)
class Machine:
    """Scores over 0 are votes for ``first``, others for ``second``."""

    first: int
    second: int
    weights: tuple[float, ...]
    offset: float


@dataclass(frozen=True)
class PairModel:
    features: CosineFeatures | None
    dim: int
    machines: tuple[Machine, ...]

    def vector(self, vector_col: str) -> Column:
        return self.features.of(F.col(vector_col)) if self.features else F.col(vector_col).cast("array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        f = self.features
        head = (self.dim, *((f.n_features, f.gamma, f.seed) if f else (None, None, None)))
        rows = [(*head, m.first, m.second, list(m.weights), m.offset) for m in self.machines]
        spark.createDataFrame(rows, _STORED).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairModel:
        rows = spark.read.schema(_STORED).parquet(path).orderBy("first", "second").collect()
        one = rows[0]
        features = CosineFeatures(one["dim"], one["n_features"], one["gamma"], one["seed"]) if one["n_features"] else None
        return cls(features, one["dim"], tuple(Machine(r["first"], r["second"], tuple(r["weights"]), r["offset"]) for r in rows))


_STORED = "dim int, n_features int, gamma double, seed int, first int, second int, weights array<double>, offset double"


def fit(
    train: DataFrame,
    dim: int,
    *,
    vector_col: str = "vector",
    label_col: str = "label",
    kernel: bool = True,
    n_features: int = 512,
    gamma: float | None = None,
    cost: float = 1.0,
    max_iter: int = 30,
    seed: int = 42,
    parallelism: int = 4,
) -> PairModel:
    """Fit a machine for each pair of classes in the rows.

    ``gamma`` defaults to 1 / (dimensions * variance). ``cost`` is the weight
    of a row's loss against half the squared length of the weights, as in the
    usual form; the fit sees the mean over the pair's rows.
    """
    rows = train.where(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull())
    features = None
    if kernel:
        features = CosineFeatures(dim, n_features, scale_gamma(rows, vector_col, dim) if gamma is None else gamma, seed)
    vector = features.of(F.col(vector_col)) if features else F.col(vector_col).cast("array<double>")
    held = settle(rows.select(F.col(label_col).cast("int").alias("label"), array_to_vector(vector).alias("features")))
    counts = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}

    def machine(pair: tuple[int, int]) -> Machine:
        first, second = pair
        own = held.where(F.col("label").isin(first, second))
        two = own.withColumn("_target", (F.col("label") == first).cast("double"))
        strength = 1.0 / (cost * (counts[first] + counts[second]))
        # The scale of the features is the kernel's: no row weights, no scaling.
        fitted = LinearSVC(featuresCol="features", labelCol="_target", maxIter=max_iter, regParam=strength, standardization=False).fit(two)
        return Machine(first, second, tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept))

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return PairModel(features, dim, tuple(pool.map(machine, combinations(sorted(counts), 2))))


def pair_scores(model: PairModel, df: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """``(keep, first, second, score)``: one row per row with a vector and machine."""
    weights = np.array([m.weights for m in model.machines]).T
    offsets = np.array([m.offset for m in model.machines])

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            block = np.array(batch.tolist(), dtype=float).reshape(len(batch), len(weights))
            yield pd.Series(list(block @ weights + offsets))

    pairs = F.array(*[F.struct(F.lit(m.first).alias("first"), F.lit(m.second).alias("second")) for m in model.machines])
    there = df.where(F.col(vector_col).isNotNull()).select(*keep, model.vector(vector_col).alias("_features"))
    scored = there.select(*keep, F.arrays_zip(pairs.alias("pair"), run("_features").alias("score")).alias("_z"))
    each = scored.select(*keep, F.explode("_z").alias("_z"))
    return each.select(*keep, F.col("_z.pair.first").alias("first"), F.col("_z.pair.second").alias("second"), F.col("_z.score").alias("score"))


def votes(scores: DataFrame, *keys: str) -> DataFrame:
    """``(keys, prediction, votes)`` from pair scores (keys, first, second, score).

    Pairs of a key are few, so they meet by one partial aggregation each.
    """
    won = scores.select(*keys, F.when(F.col("score") > 0, F.col("first")).otherwise(F.col("second")).alias("_class"))
    counted = won.groupBy(*keys, "_class").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_class")).alias("_less"))).alias("_best"))
    return best.select(*keys, (-F.col("_best._less")).cast("int").alias("prediction"), F.col("_best._n").alias("votes"))


def predicted(model: PairModel, df: DataFrame, vector_col: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``prediction``; votes are counted inside the tasks, without a shuffle."""
    weights = np.array([m.weights for m in model.machines]).T
    offsets = np.array([m.offset for m in model.machines])
    pairs = [(m.first, m.second) for m in model.machines]
    classes = sorted({c for pair in pairs for c in pair})
    place = {c: i for i, c in enumerate(classes)}
    features, dim = model.features, model.dim

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        directions, shifts = features.drawn() if features else (None, None)
        for batch in batches:
            there = batch.notna().to_numpy()
            out = pd.Series(np.full(len(batch), None), dtype="Int32")
            block = np.array(batch[there].tolist(), dtype=float).reshape(int(there.sum()), dim)
            if features:
                block = np.sqrt(2.0 / features.n_features) * np.cos(block @ directions + shifts)
            over = block @ weights + offsets > 0
            counts = np.zeros((len(block), len(classes)), int)
            for k, (first, second) in enumerate(pairs):
                counts[over[:, k], place[first]] += 1
                counts[~over[:, k], place[second]] += 1
            out[there] = np.array(classes)[counts.argmax(axis=1)]
            yield out

    return df.select(*keep, run(F.col(vector_col)).alias("prediction"))
