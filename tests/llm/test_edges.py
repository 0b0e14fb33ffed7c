"""Null ids, rows that share an id, long texts, and the bounds of packing."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwave.llm import bpe, neardup, packing, pii, quality, queries, scoring, tokenfile
from quillwave.llm.common import slices

ROWS = [
    (None, "a null id, one@two.org"), (None, None), (7, "first text of seven"), (7, "second text of seven"),
    (7, "first text of seven"), (8, ""), (9, "x" * 5000 + " y" * 5000), (10, "plain"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, ids string, start long, kept boolean, component_id long"
    return spark.createDataFrame([(*r, "clash", -1, False, -1) for r in ROWS], schema).repartition(3).cache()


def ordered(found):
    return sorted(found, key=str)


def test_bpe(docs):
    lib = Tokenizer.from_file(queries.WORD_BPE)
    got = ordered((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(bpe.encode_decode(docs, queries.WORD_BPE)).collect())
    ids = [lib.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    assert got == ordered((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for (i, _), x in zip(ROWS, ids))


def byte_ids():
    lib = Tokenizer.from_file(queries.BYTE_BPE)
    return [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for _, t in ROWS]


def test_token_files(spark, docs):
    got = tokenfile.digests(tokenfile.write_and_read(docs, queries.BYTE_BPE, spark)).collect()
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(ROWS, byte_ids())]
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered(want)
    # Null ids first, then by id; starts without gaps.
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, 7, 7, 7, 8, 9, 10]
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()


def test_packing(docs):
    got = packing.pack(docs, queries.BYTE_BPE).collect()
    want = []
    for (i, _), x in zip(ROWS, byte_ids()):
        for piece, (start, length) in enumerate(packing.cut_points(len(x), 1024)):
            want.append((i, piece, start, length, zlib.crc32(np.array(x[start : start + length], "<u4").tobytes())))
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(want)


def test_scores_rules_and_spans(spark, docs):
    labels = spark.createDataFrame([(7, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert ordered(r.doc_id for r in scoring.score(docs).collect()) == ordered(i for i, _ in ROWS)
    rules = quality.score(docs, labels).collect()
    assert ordered((r.doc_id, r.n_words) for r in rules) == ordered((i, len((t or "").split())) for i, t in ROWS)
    # One class of labels only: the classifier keeps what the rules keep.
    assert all(r.kept == (not r.base_failed) for r in rules)
    spans = pii.digests(pii.spans(docs.select("doc_id", "text"))).collect()
    assert ordered((r.doc_id, r.n_email) for r in spans) == ordered((i, int("@" in (t or ""))) for i, t in ROWS)


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {7: 7, 8: 8, 9: 9, 10: 10}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_threshold_tie_is_kept(spark):
    """A probability equal to the threshold keeps the document."""
    draw = random.Random(0)
    texts = [(i, " ".join(f"w{draw.randrange(40)}" for _ in range(30))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    first = {r.doc_id: r.quality for r in quality.score(df, labels).collect()}
    middle = sorted(first.values())[20]
    kept = {r.doc_id for r in quality.score(df, labels, threshold=middle).collect() if r.kept}
    assert kept == {i for i, q in first.items() if q >= middle} and len(kept) < 40


def test_long_labelled_text_teaches(spark):
    """The fit uses labelled texts whatever their length."""
    long = " ".join(f"word{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, "short one"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    vectors, known = quality.labelled_sample(df, labels, 100)
    assert known == [1, 0]
    at, value = quality.vector(long)
    assert np.array_equal(vectors[0][0], at) and np.allclose(vectors[0][1], value, atol=1e-6)


def test_slices_never_cut_a_text():
    texts = pa.array(["a" * 10, "b" * 500, "", "c" * 3, None, "d" * 90])
    cuts = list(slices(texts.fill_null(""), 50))
    # A run ends with the text that fills it, however long that is.
    assert cuts == [range(0, 2), range(2, 6)]


def test_groups_of_packing_are_bounded(spark):
    """Sizes that never fill a sequence: rounds end, groups stay small, all is placed."""
    draw = np.random.default_rng(0)
    sizes = draw.integers(260, 521, 6000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")
    for rounds in (1, 8):
        placed, certificates = packing.place(items, 1024, per_group=500, max_rounds=rounds)
        rows = placed.collect()
        assert sorted(r.doc_id for r in rows) == list(range(6000))
        held = {}
        for r in rows:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in held.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
        groups = [c for certificate in certificates for c in certificate.collect()]
        assert max(g.pieces for g in groups) < 700 and all(g.sequences >= g.bound for g in groups)
        # No two sequences could be one, but for what other groups hold; not far above the bound of all pieces.
        assert len(held) <= 1.15 * packing.lower_bound(sizes, 1024)
    assert len(certificates) <= 8


def test_nearly_all_groups_meet_the_bound(spark):
    """Many small pieces: the number of sequences is the bound."""
    sizes = np.random.default_rng(1).integers(1, 200, 4000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long")
    placed, _ = packing.place(items, 1024, per_group=600)
    assert placed.select("sequence_id").distinct().count() <= packing.lower_bound(sizes, 1024) + 1
    assert placed.agg(F.sum("length")).first()[0] == int(sizes.sum())


def test_fit_vectors_are_views_of_columns(spark):
    """4 bytes a number: the driver held Python lists of them and went beyond its memory."""
    df = spark.createDataFrame([(i, f"text number {i} of a few") for i in range(60)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    vectors, known = quality.labelled_sample(df, labels, 100)
    assert known == [i % 2 for i in range(60)]
    assert {(at.dtype.str, value.dtype.str, at.base is not None) for at, value in vectors} == {("<i4", "<f4", True)}
    for i, (at, value) in enumerate(vectors):
        want = quality.vector(f"text number {i} of a few")
        assert np.array_equal(at, want[0]) and np.allclose(value, want[1], atol=1e-6)
