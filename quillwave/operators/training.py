"""Mini-batch training of a fully connected network, epoch by epoch.

The train rows are laid out once over ``workers`` partitions. An epoch is one
barrier job in which every task streams its rows in an order of its own for
that epoch. Nothing but numbers of the model travels; rows stay where they are.

* With ``local_steps`` = 1 all tasks take every step together on one mini-batch:
  each brings its share of the rows, the sums of the gradients are exchanged,
  and all make the same Adam update.
* Otherwise each task takes that many steps on mini-batches of its own, and
  then weights and moments are averaged by rows seen (local steps, Stich 2019).

An exchange takes Spark about a second whatever its size, so single steps pay
only where a mini-batch is large.

After each epoch the state (weights and both Adam moments) is written to the
shared folder, and loss and accuracy of both parts are added up by a plain
job. A lost executor repeats one epoch from the state before it, and so does a
later call with the same folder.

An exchange sends ``workers`` messages to each worker, through the scheduler.
``most_message_mb`` bounds their sum; beyond it, take fewer workers.

Defined results: rows without a vector or label take no part. A part without
rows is not in the log. A partition without rows takes part in the exchanges
with nothing.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.operators.metrics import best_checkpoint
from quillwave.session import settle

# The usual decay rates and offset of Adam.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Network:
    """Sizes of input, hidden and output layers.

    The first layer has no activation; every further hidden layer has ReLU and
    drops each value with the chance ``dropout`` while training.
    """

    sizes: tuple[int, ...]
    dropout: float = 0.0

    @property
    def n_layers(self) -> int:
        return len(self.sizes) - 1

    @property
    def n_parameters(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes, self.sizes[1:]))

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within 1 / sqrt(inputs) of a layer, weights and offsets."""
        draw = np.random.default_rng(seed)
        layers = [draw.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in zip(self.sizes, self.sizes[1:])]
        return np.concatenate(layers)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of the weights (inputs x outputs) and offsets of each layer."""
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def _rectified(self, layer: int) -> bool:
        return 0 < layer < self.n_layers - 1

    def scores(self, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
        held = rows
        for layer, (weights, offsets) in enumerate(self.layers(flat)):
            held = held @ weights + offsets
            if self._rectified(layer):
                held = np.maximum(held, 0)
        return held

    def gradient(self, flat: np.ndarray, rows: np.ndarray, labels: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        """Sum over the rows of the gradient of the cross-entropy."""
        layers = self.layers(flat)
        inputs, gates, held = [], [], rows
        for layer, (weights, offsets) in enumerate(layers):
            inputs.append(held)
            held = held @ weights + offsets
            gate = None
            if self._rectified(layer):
                gate = (held > 0).astype(float)
                if self.dropout:
                    gate *= (draw.random(gate.shape) >= self.dropout) / (1 - self.dropout)
                held = held * gate
            gates.append(gate)
        slope = softmax(held)
        slope[np.arange(len(labels)), labels] -= 1
        out = np.empty_like(flat)
        for layer in range(self.n_layers - 1, -1, -1):
            if gates[layer] is not None:
                slope = slope * gates[layer]
            weights, offsets = self.layers(out)[layer]
            weights[:] = inputs[layer].T @ slope
            offsets[:] = slope.sum(axis=0)
            slope = slope @ layers[layer][0].T
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def losses(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Cross-entropy of each row."""
    top = scores.max(axis=1)
    return np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - scores[np.arange(len(labels)), labels]


@dataclass
class State:
    """Weights and both Adam moments, as one vector each, after ``steps`` steps."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls, weights: np.ndarray) -> State:
        return cls(weights.astype(float).copy(), np.zeros(len(weights)), np.zeros(len(weights)))

    def update(self, gradient: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.first = BETA1 * self.first + (1 - BETA1) * gradient
        self.second = BETA2 * self.second + (1 - BETA2) * gradient**2
        first = self.first / (1 - BETA1**self.steps)
        second = self.second / (1 - BETA2**self.steps)
        self.weights = self.weights - rate * first / (np.sqrt(second) + EPSILON)

    def packed(self) -> bytes:
        return np.concatenate([self.weights, self.first, self.second]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, steps: int) -> State:
        return cls(*(p.copy() for p in np.frombuffer(raw, "<f8").reshape(3, -1)), steps)


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of the first two columns."""
    vectors = batch.column(0)
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), dim)
    return rows, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def portions(batches: Iterable[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of exactly ``size`` rows, the last one shorter; holds little more than that many rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0
    for rows, labels in batches:
        while have + len(rows) >= size:
            cut = size - have
            held.append((rows[:cut], labels[:cut]))
            yield np.concatenate([r for r, _ in held]), np.concatenate([y for _, y in held])
            held, have, rows, labels = [], 0, rows[cut:], labels[cut:]
        if len(rows):
            held.append((rows, labels))
            have += len(rows)
    if held:
        yield np.concatenate([r for r, _ in held]), np.concatenate([y for _, y in held])


_STATE = "epoch int, steps bigint, state binary"


@dataclass(frozen=True)
class Plan:
    """How an epoch is cut into steps."""

    batch: int
    workers: int
    local_steps: int
    rate: float
    seed: int

    @property
    def rows(self) -> int:
        """Rows of one step of one worker."""
        return max(1, self.batch // self.workers) if self.local_steps == 1 else self.batch

    def exchanges(self, most_rows: int) -> int:
        """How often all workers meet if the largest partition has ``most_rows`` rows."""
        return -(-most_rows // (self.rows * self.local_steps))


def averaged(brought: list[np.ndarray]) -> State:
    """Mean of packed states by rows; each is (rows, steps, weights, moments)."""
    rows = sum(b[0] for b in brought)
    mean = np.sum([b[0] / rows * b[2:] for b in brought], axis=0)
    return State(*np.split(mean, 3), int(max(b[1] for b in brought)))


def _epoch(laid: DataFrame, network: Network, state: State, epoch: int, plan: Plan, exchanges: int) -> DataFrame:
    """One row: the state after one pass over the rows of ``laid`` (id, vector, label), a barrier job."""
    spark = laid.sparkSession
    # Bounded by the size of the model, which train_epochs has checked.
    sent = spark.sparkContext.broadcast((state.packed(), state.steps))
    dim = network.sizes[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        own = State.unpacked(*sent.value)
        mine = portions((_matrix(b, dim) for b in batches), plan.rows)

        def exchanged(numbers: np.ndarray | None) -> list[np.ndarray]:
            message = "" if numbers is None else base64.b64encode(numbers.astype("<f8").tobytes()).decode()
            return [np.frombuffer(base64.b64decode(m), "<f8") for m in context.allGather(message) if m]

        def gradient(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
            return network.gradient(own.weights, rows, labels, np.random.default_rng([plan.seed, epoch, own.steps, context.partitionId()]))

        for _ in range(exchanges):
            if plan.local_steps == 1:
                some = next(mine, None)
                brought = exchanged(None if some is None else np.append(gradient(*some), len(some[0])))
                summed = np.sum(brought, axis=0)
                own.update(summed[:-1] / summed[-1], plan.rate)
            else:
                seen = 0
                for rows, labels in itertools.islice(mine, plan.local_steps):
                    own.update(gradient(rows, labels) / len(rows), plan.rate)
                    seen += len(rows)
                packed = np.frombuffer(own.packed(), "<f8")
                own = averaged(exchanged(np.append([seen, own.steps], packed) if seen else None))
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays(
                [pa.array([epoch], pa.int32()), pa.array([own.steps], pa.int64()), pa.array([own.packed()], pa.binary())],
                ["epoch", "steps", "state"],
            )

    order = F.xxhash64(F.lit(plan.seed), F.lit(epoch), "id")
    return laid.sortWithinPartitions(order, "id").select("vector", "label").mapInArrow(run, _STATE, barrier=True)


def part_losses(rows: DataFrame, network: Network, weights: np.ndarray) -> DataFrame:
    """``(part, n, loss, accuracy)`` of rows (vector, label, part): mean cross-entropy and share of right labels.

    Scored in Arrow batches; one row per batch and part leaves a task.
    """
    dim = network.sizes[0]
    sent = rows.sparkSession.sparkContext.broadcast(weights.astype("<f8"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, labels = _matrix(batch, dim)
            scores = network.scores(sent.value, held)
            loss, right = losses(scores, labels), scores.argmax(axis=1) == labels
            parts = np.array(batch.column(2).to_pylist(), dtype=object)
            out = [(part, int(own.sum()), float(loss[own].sum()), int(right[own].sum())) for part in set(parts) for own in [parts == part]]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "n", "loss", "right"), row)) for row in out], schema)

    schema = pa.schema([("part", pa.string()), ("n", pa.int64()), ("loss", pa.float64()), ("right", pa.int64())])
    partial = rows.select("vector", "label", "part").mapInArrow(run, "part string, n bigint, loss double, right bigint")
    return partial.groupBy("part").agg(
        F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("right") / F.sum("n")).alias("accuracy")
    )


@dataclass
class Training:
    """``log`` has (epoch, part, n, loss, accuracy); ``best_epoch`` the lowest dev loss, the first one on ties."""

    network: Network
    log: DataFrame
    best_epoch: int
    best_weights: np.ndarray
    folder: str


def stored_state(spark: SparkSession, folder: str, epoch: int) -> State:
    row = spark.read.schema(_STATE).parquet(f"{folder}/state/epoch-{epoch:05d}").first()
    return State.unpacked(row["state"], row["steps"])


def _is_stored(spark: SparkSession, path: str) -> bool:
    """A finished write below the shared folder."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def train_epochs(
    rows: DataFrame,
    network: Network,
    folder: str,
    *,
    id_col: str = "id",
    vector_col: str = "vector",
    label_col: str = "label",
    dev_col: str = "is_dev",
    epochs: int = 50,
    batch: int = 32,
    rate: float = 1e-4,
    workers: int | None = None,
    local_steps: int = 32,
    seed: int = 42,
    weights: np.ndarray | None = None,
    most_message_mb: int = 512,
) -> Training:
    """Train on the rows that aren't ``dev_col``; log both parts after every epoch and keep the best state.

    ``folder`` is a path on shared storage. Epochs that it holds already are
    not run again. ``workers`` defaults to the cores of the session, at most 8:
    all of them run at the same time.
    """
    spark = rows.sparkSession
    workers = workers or min(8, spark.sparkContext.defaultParallelism)
    plan = Plan(batch, workers, local_steps, rate, seed)
    numbers = network.n_parameters * (1 if local_steps == 1 else 3)
    size = workers * workers * numbers * 8 * 4 / 3 / 1e6
    if size > most_message_mb:
        raise ValueError(f"an exchange would take {size:.0f} MB; take fewer workers than {workers}")
    used = rows.where(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull())
    part = F.when(F.col(dev_col), "dev").otherwise("train")
    held = settle(used.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("int").alias("label"), part.alias("part")))
    laid = settle(held.where("part = 'train'").drop("part").repartition(workers, "id"))
    largest = laid.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("n")).first()["n"] or 0
    exchanges = plan.exchanges(largest)
    state = State.start(network.initial(seed) if weights is None else weights)
    for epoch in range(1, epochs + 1):
        stored, logged = f"{folder}/state/epoch-{epoch:05d}", f"{folder}/log/epoch-{epoch:05d}"
        if not _is_stored(spark, stored):
            _epoch(laid, network, state, epoch, plan, exchanges).write.mode("overwrite").parquet(stored)
        state = stored_state(spark, folder, epoch)
        if not _is_stored(spark, logged):
            now = part_losses(held, network, state.weights).select(F.lit(epoch).alias("epoch"), "part", "n", "loss", "accuracy")
            now.coalesce(1).write.mode("overwrite").parquet(logged)
    log = spark.read.schema("epoch int, part string, n bigint, loss double, accuracy double").parquet(
        *[f"{folder}/log/epoch-{epoch:05d}" for epoch in range(1, epochs + 1)]
    )
    named = log.where("part = 'dev'").withColumn("run", F.lit(0)).withColumn("model", F.col("epoch"))
    best = best_checkpoint(named, ["run"], "model", "loss", "epoch").first()
    chosen = best["epoch"] if best else epochs
    return Training(network, log, chosen, stored_state(spark, folder, chosen).weights, folder)


def predicted(rows: DataFrame, training: Training, vector_col: str, *keep: str) -> DataFrame:
    """``keep`` and the class of the highest score by the best state; the first one on ties, null without a vector."""
    network, dim = training.network, training.network.sizes[0]
    sent = rows.sparkSession.sparkContext.broadcast(training.best_weights)

    @F.pandas_udf("int")
    def best(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in vectors:
            there = some.notna()
            out = pd.Series(np.full(len(some), None), dtype="Int32")
            if there.any():
                block = np.stack(some[there].to_list()).astype(float).reshape(-1, dim)
                out[there.to_numpy()] = network.scores(sent.value, block).argmax(axis=1)
            yield out

    return rows.select(*keep, best(F.col(vector_col)).alias("prediction"))
