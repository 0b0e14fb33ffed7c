"""Language-model scores by context-tree weighting over bytes.

A text (A-Z lower-cased, UTF-8) is coded byte by byte, with one end byte. Each
byte is eight binary decisions along its bits, each in the context of the bytes
before, down to ``DEPTH`` bytes. Every context of every depth has a
Krichevsky-Trofimov estimate per decision; context-tree weighting mixes them
over all depths, with weights from how well each subtree codes the training
texts.

All counts come from one table of byte 5-grams. Contexts that share their two
newest bytes are worked out together (at most 256^3 grams, whatever the
corpus), the two shallow depths from small sums over those. The result is a
table of the code length of each 5-gram of the corpus.

Words and 5-grams that occur often are sent to the tasks (a bounded number of
each); the others are joined by shuffle. Both ways give the same sums.

Defined results: null text counts as empty (one end token). A document with a
null id is a training document. Repeated rows are counted and scored each. With
no training documents every estimate is even.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import LOWER_ASCII, arrow_schema, on_batches, slices, written

DEPTH = 4
# In no UTF-8 text: fills the context before a text and ends it.
_EDGE = b"\xff"
_STEP = 2_000_000
_FLUSH = 250_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All (DEPTH + 1)-grams of the texts as integers, and where each text's begin (with the end)."""
    raw = np.frombuffer(_EDGE * DEPTH + b"".join([t + _EDGE * DEPTH for t in texts]), np.uint8).astype(np.int64)
    gram = np.zeros(len(raw) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        gram = (gram << 8) | raw[k : len(raw) - DEPTH + k]
    # A text of n bytes owns its n bytes and one end byte; the other edges are padding.
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes + DEPTH - 1) - (sizes + DEPTH - 1)
    owned = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return gram[owned], np.append(0, np.cumsum(sizes))


def is_held_out(doc_id: object, tenth: int = 0) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == tenth


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and lower-cased texts of a batch, a few MB at a time."""
    texts = batch.column(1).cast(pa.string()).fill_null("")
    for rows in slices(texts, _STEP):
        some = texts[rows.start : rows.stop].to_pylist()
        yield batch.column(0)[rows.start : rows.stop], [t.encode().translate(LOWER_ASCII) for t in some]
    pa.default_memory_pool().release_unused()


def counts(docs: DataFrame) -> DataFrame:
    """(word, gram, n): counts in training texts. Either key is null; grams of held-out texts come with 0."""
    schema = "word binary, gram bigint, n bigint"
    arrow = arrow_schema(schema)

    def rows(words: Counter, gram: dict[int, int]) -> Iterator[pa.RecordBatch]:
        for keys, values, at in ((list(words), list(words.values()), 0), (list(gram), list(gram.values()), 1)):
            for begin in range(0, len(keys), 100_000):
                part = keys[begin : begin + 100_000]
                columns = [pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64())]
                columns[at] = pa.array(part, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values[begin : begin + 100_000], pa.int64())], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        gram: dict[int, int] = {}
        for batch in batches:
            for names, texts in _parts(batch):
                held = [is_held_out(i) for i in names.to_pylist()]
                for out in (False, True):
                    some = [t for t, h in zip(texts, held) if h == out]
                    if not some:
                        continue
                    if not out:
                        for text in some:
                            words.update(text.split())
                    found = pa.array(grams(some)[0]).value_counts()
                    keys, n = found.field(0).to_pylist(), found.field(1).to_pylist()
                    for key, value in zip(keys, [0] * len(n) if out else n):
                        gram[key] = gram.get(key, 0) + value
                if len(words) + len(gram) > _FLUSH:
                    yield from rows(words, gram)
                    words, gram = Counter(), {}
        yield from rows(words, gram)

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "counts")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (eight steps up, then Stirling's series)."""
    up = x + 8.0
    steps = sum(np.log(x + k) for k in range(8))
    inverse = 1 / up
    series = inverse * (1 / 12 - inverse * inverse * (1 / 360 - inverse * inverse / 1260))
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - steps


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - np.log(np.pi) - _lgamma(n0 + n1 + 1.0)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the mixture of a context's own estimate and its children's, and the weight of the own one."""
    mixture = np.logaddexp(own, below) - np.log(2)
    return mixture, np.exp(own - np.log(2) - mixture)


def subtree(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Depths 2 to DEPTH of contexts that share their two newest bytes.

    Returns the chance of each of the eight decisions of each gram, and per
    decision node of depth 2: node, zeros, ones, log mixture.
    """
    byte = gram & 255
    step = np.arange(8)[:, None]
    node = (1 << step) | (byte >> (8 - step))
    bit = (byte >> (7 - step)) & 1
    mixture = chance = below = None
    for depth in range(DEPTH, 1, -1):
        # The bytes of the context that are older than the two shared ones.
        older = (gram >> 24) & ((1 << 8 * (depth - 2)) - 1)
        nodes, back = np.unique((older << 8 | node).ravel(), return_inverse=True)
        ones = np.bincount(back, (n * bit).ravel(), len(nodes))
        zeros = np.bincount(back, (n * (1 - bit)).ravel(), len(nodes))
        own = log_kt(zeros, ones)
        if mixture is None:
            mixture, weight = own, np.ones(len(nodes))
        else:
            # Every node of this depth has children, the same decisions after longer contexts.
            parent = np.searchsorted(nodes, below)
            mixture, weight = weighted(own, np.bincount(parent, mixture, len(nodes)))
        mine, back = weight[back].reshape(8, -1), back.reshape(8, -1)
        estimate = (np.where(bit, ones[back], zeros[back]) + 0.5) / (zeros + ones + 1)[back]
        chance = estimate if chance is None else mine * estimate + (1 - mine) * chance
        below = ((nodes >> 8) & ((1 << 8 * max(depth - 3, 0)) - 1)) << 8 | (nodes & 255)
    return chance, (nodes & 255, zeros, ones, mixture)


def code_lengths(table: DataFrame) -> DataFrame:
    """(gram, n, score): log10 probability of the last byte of each gram after the others."""
    schema = "gram bigint, n bigint, chances binary, sums binary"
    arrow = arrow_schema(schema)

    def run(group: pa.Table) -> pa.Table:
        gram, n = group.column("gram").to_numpy(), group.column("n").to_numpy()
        chance, (node, zeros, ones, mixture) = subtree(gram, n)
        sums = np.zeros((3, 256))
        sums[:, node] = zeros, ones, mixture
        size = len(gram)
        raw = chance.T.astype("<f4").tobytes()
        return pa.Table.from_arrays(
            [
                pa.array(np.append(gram, gram[:1])),
                pa.array(np.append(n, -1)),
                pa.array([raw[32 * i : 32 * i + 32] for i in range(size)] + [None], pa.binary()),
                pa.array([None] * size + [sums.tobytes()], pa.binary()),
            ],
            schema=arrow,
        )

    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros((3, 256))
        for one in group.column("sums"):
            total += np.frombuffer(one.as_py()).reshape(3, 256)
        return pa.table([group.column("newest")[:1], pa.array([total.tobytes()], pa.binary())], names=["newest", "sums"])

    deep = written(table.groupBy(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair")).applyInArrow(run, schema), "contexts")
    # One row for each pair of newest bytes, then one for each newest byte: at most 256 reach the driver.
    newest = (
        deep.where("sums IS NOT NULL")
        .select(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFF)).alias("newest"), "sums")
        .groupBy("newest")
        .applyInArrow(add_up, "newest bigint, sums binary")
        .collect()
    )
    zeros, ones, below = np.zeros((3, 256, 256))
    for row in newest:
        zeros[row["newest"]], ones[row["newest"]], below[row["newest"]] = np.frombuffer(row["sums"]).reshape(3, 256)
    mixture1, weight1 = weighted(log_kt(zeros, ones), below)
    total0, total1 = zeros.sum(axis=0), ones.sum(axis=0)
    _, weight0 = weighted(log_kt(total0, total1), mixture1.sum(axis=0))
    one1, one0 = (ones + 0.5) / (zeros + ones + 1), (total1 + 0.5) / (total0 + total1 + 1)

    def shallow(batch: pa.RecordBatch) -> Iterator[list]:
        gram = batch.column(0).to_numpy()
        chance = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(-1, 8).astype(np.float64)
        score = np.zeros(len(gram))
        byte, last = gram & 255, (gram >> 8) & 255
        for k in range(8):
            node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            p1 = np.where(bit, one1[last, node], 1 - one1[last, node])
            p0 = np.where(bit, one0[node], 1 - one0[node])
            p = weight1[last, node] * p1 + (1 - weight1[last, node]) * chance[:, k]
            score += np.log10(weight0[node] * p0 + (1 - weight0[node]) * p)
        yield [batch.column(0), batch.column(1), pa.array(score)]

    return written(on_batches(deep.where("sums IS NULL"), shallow, "gram bigint, n bigint, score double"), "scores")


def _frequent(table: DataFrame, most: int) -> int:
    """The lowest power of two such that at most ``most`` rows have an ``n`` of it or more."""
    kept = 0
    found = table.where("n > 0").groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    for row in sorted(found, key=lambda r: -r["power"]):
        kept += row["count"]
        if kept > most:
            return 1 << (row["power"] + 1)
    return 1


def score(docs: DataFrame, sent_words: int = 400_000, sent_grams: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``sent_words`` and ``sent_grams`` bound what is sent to the tasks; rarer
    ones are joined.
    """
    spark = docs.sparkSession
    found = counts(docs)
    words = written(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    lengths = code_lengths(found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    identity = F.col("doc_id").cast("string")
    held_out: Column = F.coalesce(F.crc32(F.encode(identity, "UTF-8")) % 10 == 0, F.lit(False))
    ends = docs.where(~held_out).count()
    tokens, distinct = (total[0] or 0) + ends, total[1] + (ends > 0)
    divisor = tokens + 0.1 * (distinct + 1)

    least_word, least_gram = _frequent(words, sent_words), _frequent(lengths, sent_grams)
    often = words.where(F.col("n") >= least_word).collect()
    known = {bytes(r["word"]): float(np.log10((r["n"] + 0.1) / divisor)) for r in often}
    often = lengths.where(F.col("n") >= least_gram).select("gram", "score").orderBy("gram").toArrow()
    sent = spark.sparkContext.broadcast((known, often.column(0).to_numpy(), often.column(1).to_numpy()))
    end_score = float(np.log10((ends + 0.1) / divisor))

    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, row bigint, n_tokens bigint, n_known bigint, n_bytes bigint, base double, code double, "
        "words array<struct<word:binary,n:bigint>>, grams array<struct<gram:bigint,n:bigint>>"
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, values = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for names, some in _parts(batch):
                out: list[list] = [[] for _ in range(9)]
                gram, bounds = grams(some)
                coded = pa.array(gram).dictionary_encode()
                distinct = coded.dictionary.to_numpy()
                at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
                hit = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
                value = np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(distinct))
                places = coded.indices.to_numpy()
                codes = np.add.reduceat(value[places], bounds[:-1])
                missed = ~hit[places]
                for k, text in enumerate(some):
                    held = text.split()
                    scores = list(map(known.get, held))
                    rare = Counter(w for w, s in zip(held, scores) if s is None) if None in scores else {}
                    mine = slice(bounds[k], bounds[k + 1])
                    lost = Counter(gram[mine][missed[mine]].tolist()) if missed[mine].any() else {}
                    unknown = sum(rare.values())
                    fields = (
                        row,
                        len(held) + 1,
                        len(held) - unknown + (ends > 0),
                        len(text) + 1,
                        sum(s for s in scores if s is not None) + end_score,
                        float(codes[k]),
                        [{"word": w, "n": n} for w, n in rare.items()],
                        [{"gram": g, "n": n} for g, n in lost.items()],
                    )
                    for column, field in zip(out[1:], fields):
                        column.append(field)
                    row += 1
                columns = [names, *out[1:]]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    rows = written(docs.select("doc_id", "text").mapInArrow(run, schema), "rows")
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(divisor))
    rare = rows.select("row", F.explode("words").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("times"))
    rare = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * base).alias("more_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    lost = rows.select("row", F.explode("grams").alias("g")).select("row", F.col("g.gram").alias("gram"), F.col("g.n").alias("times"))
    lost = lost.join(lengths.drop("n"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("more_code"))
    joined = rows.drop("words", "grams").join(rare, "row", "left").join(lost, "row", "left")
    code = F.col("code") + F.coalesce("more_code", F.lit(0.0))
    return joined.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        code.alias("score"),
        (-code * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
