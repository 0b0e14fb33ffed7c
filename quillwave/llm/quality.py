"""Quality rules: fixed text rules, then a classifier on hashed n-grams.

Word unigrams and bigrams and character trigrams and 4-grams are hashed into
one table of weights. A logistic regression is trained on labelled rows by
mini-batch steps, and its output is calibrated on held-out labelled rows (Platt
scaling). Texts are scored whole, in Arrow batches, against fixed thresholds.

Defined results: null text has no words and fails the word-count rule; so does
an empty one. Repeated rows get equal results. Without usable labels (none, or
one class only) the classifier keeps everything. Labels of unknown documents
and null labels are not used; of several labels of one document the smallest
counts. Extra columns are not read. Texts of any length are scored whole, and
used whole in the fit. A probability equal to the threshold is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import on_batches

_BITS = 18
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
# An odd multiplier per place in a word; the places of longer words repeat them.
_PLACES = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply and two shifts)."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and 64-bit hash of each word of UTF-8 bytes."""
    edge = np.diff(np.concatenate([[True], _GAPS[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = ~_GAPS[raw]
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    term = mixed((raw[inside].astype(np.uint64) + np.uint64(1)) * _PLACES[place & 4095] + (place >> 12).astype(np.uint64))
    return starts, sizes, mixed(np.add.reduceat(term, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def features(text: str) -> np.ndarray:
    """Hashed features of a whole text, one entry per occurrence."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = word_hashes(raw)[2]
    parts = [words, mixed(words[:-1] + (words[1:] << np.uint64(1)) + np.uint64(1))]
    wide = raw.astype(np.uint64)
    for n in (3, 4):
        if len(raw) >= n:
            gram = np.full(len(raw) - n + 1, n, np.uint64)
            for k in range(n):
                gram = (gram << np.uint64(8)) | wide[k : len(raw) - n + 1 + k]
            parts.append(mixed(gram))
    return (np.concatenate(parts) >> np.uint64(64 - _BITS)).astype(np.int64)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values: damped counts on the unit sphere."""
    at, counts = np.unique(features(text), return_counts=True)
    value = np.log1p(counts)
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: str) -> float:
        at, value = vector(text)
        raw = float(self.weights[at] @ value) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40))))


def train(
    vectors: list[tuple[np.ndarray, np.ndarray]], known: list[int], passes: int = 12, rate: float = 2.0, seed: int = 1
) -> Classifier | None:
    """Fit on the vectors and labels of four fifths of the rows, calibrate on the others.

    Both classes weigh the same in the fit; calibration restores the true
    shares. Every row is used the same way whatever its length.
    """
    labels = np.array(known, np.float64)
    if len(set(labels.tolist())) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(vectors))
    held, fit = order[::5], np.setdiff1d(order, order[::5], assume_unique=True)
    if len(set(labels[fit].tolist())) < 2:
        held, fit = order, order
    share = labels[fit].mean()
    weights, squares, bias = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-6), 0.0
    random = np.random.default_rng(seed)
    for _ in range(passes):
        for i in random.permutation(fit):
            at, value = vectors[i]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -40, 40)))
            gradient = (p - labels[i]) * (0.5 / share if labels[i] else 0.5 / (1 - share))
            step = gradient * value + 1e-5 * weights[at]
            squares[at] += step * step
            weights[at] -= rate * 0.1 * step / np.sqrt(squares[at] + 1e-3)
            bias -= 0.02 * gradient
    raw = np.array([weights[vectors[i][0]] @ vectors[i][1] + bias for i in held])
    slope, shift = _platt(raw, labels[held])
    return Classifier(weights.astype(np.float32), bias, slope, shift)


def _platt(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through smoothed targets (Newton steps)."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(g * raw).sum(), g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Vectors and labels of at most ``rows`` labelled documents, whole texts of any length, in hash order.

    The tasks make the vectors, so no text reaches the driver; a vector has
    2^18 entries at most, whatever the length of its text.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("_label"))
    )
    # Half of the sample for each class, so rare classes are in it.
    picked = known.where("_label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    picked = picked.unionByName(known.where("_label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        made = [vector(text) for text in batch.column(1).to_pylist()]
        yield [batch.column(0), batch.column(2), [a.astype(np.int32) for a, _ in made], [v.astype(np.float32) for _, v in made], batch.column(3)]

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, label int, at array<int>, value array<float>, digest string"
    vectors = on_batches(texts.select("doc_id", "text", "_label", F.md5("text")), run, schema)
    # Of rows that share an id the one with the smallest digest counts.
    first = vectors.groupBy("doc_id").agg(F.min_by(F.struct("label", "at", "value"), "digest").alias("r"))
    # As Arrow columns: Python lists of the numbers would take ten times the memory.
    got = first.select("doc_id", "r.label", "r.at", "r.value").toArrow().sort_by("doc_id")
    return [*zip(_rows(got["at"]), _rows(got["value"]), strict=True)], got["label"].to_pylist()


def _rows(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its numbers."""
    out = []
    for chunk in lists.chunks:
        numbers, edges = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [numbers[a:b] for a, b in zip(edges, edges[1:])]
    return out


def _rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, _, words = word_hashes(raw)
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(text)), 0, 0
    characters = len(text) - int(_GAPS[raw].sum())
    lines = Counter(line for line in text.encode().split(b"\n") if line.strip(b" \t\n\r\x0b\x0c"))
    repeated_lines = sum(lines.values()) - len(lines)
    return n, characters, len(_SYMBOLS.findall(text)), repeated_lines, _repeat_words(text, words)


def _repeat_words(text: str, words: np.ndarray) -> int:
    n = len(words)
    if n < 6:
        return 0
    window = words[: n - 4].copy()
    for k in range(1, 5):
        window = mixed(window) + words[k : n - 4 + k]
    _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    # Hashes only nominate; the windows they name are compared as words.
    names = text.encode().split()
    places = np.flatnonzero(counts[back] > 1).tolist()
    seen = Counter(tuple(names[p : p + 5]) for p in places)
    covered = np.zeros(n + 5, np.int64)
    for p in places:
        if seen[tuple(names[p : p + 5])] > 1:
            covered[p] += 1
            covered[p + 5] -= 1
    return int((np.cumsum(covered)[:n] > 0).sum())


def score(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 4_000,
    least_words: int = 10,
    repeat_percent: int = 20,
    threshold: float = 0.4,
) -> DataFrame:
    """Rule counts, ``quality`` (calibrated probability), ``base_failed`` and ``kept`` of every document.

    The classifier is fitted by the driver on the vectors of at most
    ``sample_rows`` labelled documents and sent to the tasks as 2^18 weights.
    """
    fitted = train(*labelled_sample(docs, labels, sample_rows))
    numbers = docs.sparkSession.sparkContext.broadcast(astuple(fitted) if fitted else None)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        model = Classifier(*numbers.value) if numbers.value else None
        out: list = [batch.column(0), *([] for _ in range(8))]
        for text in batch.column(1).to_pylist():
            text = text or ""
            counts = _rules(text)
            failed = counts[0] < least_words or 100 * counts[4] > repeat_percent * counts[0]
            quality = model.probability(text) if model else 1.0
            for column, value in zip(out[1:], (*counts, quality, failed, not failed and quality >= threshold)):
                column.append(value)
        yield out

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, quality double, base_failed boolean, kept boolean"
    )
    return on_batches(docs.select("doc_id", "text"), run, schema)
