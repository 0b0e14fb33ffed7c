"""Queries of single steps: hand-set labels, strict lookup, recordings on disk, stamps, user functions, one sentence."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillwave.functions.text import run_stamp
from quillwave.operators import labels, models, trials, vectors, vocabulary
from quillwave.operators.ranking import global_rank
from quillwave.operators.skew import attach_by_key
from quillwave.plans import tweets
from quillwave.plans.oracles import ENCODED, EXCLUDED_SUBJECTS, ID_SCORES, ORACLES, RANKED, WORDS
from quillwave.plans.queries import (
    DIM,
    ENCODED_LENGTH,
    _event_recordings,
    _frequent_vocabulary,
    _make_id_toy,
    disagreeing,
    documents,
    events,
    rounded,
    table,
    word_vectors,
)
from quillwave.session import scratch_path, settle
from quillwave.sources import files, recordings, sinks
from quillwave.streaming import batch_files, conflict_stream, lookup_stream

SENTENCE = "The and of, que UN-known-word le der!"
RUNS = (3, 7, 11)


def set_label(spark, sf_dir):
    """The label of one row set by hand, the last id of the table."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    last = rows.agg(F.max("doc_id").alias("id")).first()["id"]
    return labels.set_label(rows, "doc_id", -1 if last is None else last, "label", 9)


def strict_lookup(spark, sf_dir):
    """Every word has a vector here, the embedding numbered by its rank modulo their number; then the mean is strict."""
    ranked = vocabulary.frequency_rank(vocabulary.word_counts(documents(spark, sf_dir), "text"))
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("vector"))
    number = stored.count()
    every = settle(ranked.withColumn("_vec", F.pmod(F.col("place"), F.lit(max(number, 1)))).join(stored, "_vec").select("word", "vector"))
    vectors.require_known(documents(spark, sf_dir), "text", every)
    mean = vectors.mean_vectors(documents(spark, sf_dir), "doc_id", "text", every, DIM)
    total = F.aggregate("vector", F.lit(0.0), lambda held, x: held + x)
    return mean.select("doc_id", "n_tokens", rounded(total, "total"))


def stored_mean_vector(spark, sf_dir):
    """Mean vectors from a bucketed table, with so small a broadcast that most words are looked up in it."""
    name = f"vectors_{uuid.uuid4().hex}"
    vectors.store_vectors(word_vectors(spark, sf_dir), name, DIM, 8, path=scratch_path(spark, "stored"))
    few = vectors.VectorLimits(broadcast_bytes=50 * (4 * DIM + 64))
    found = settle(vectors.mean_vectors_stored(documents(spark, sf_dir), "doc_id", "text", name, DIM, few))
    spark.sql(f"DROP TABLE {name}")
    return vectors.exploded(found, "doc_id").select("doc_id", "k", rounded("value", "value"))


def recording_scan(spark, sf_dir):
    """Events as recordings on disk, one folder per subject and run; only three runs and no excluded subject are read."""
    samples, _ = _event_recordings(spark, sf_dir)
    path = scratch_path(spark, "recordings")
    sinks.write_recordings(samples.select("t", F.lit("T0").alias("marker"), "values", "subject", "run"), path)
    scanned = files.read_recordings(spark, path, RUNS, lambda rows: trials.exclude_keys(rows, "subject"))
    return files.recording_name(scanned).select("path", rounded("t", "t"), F.get("values", F.lit(0)).alias("value"))


def binary_recordings(spark, sf_dir):
    """Events as binary recordings, one per user and one sample a second; other users' files are never opened."""
    numbered = global_rank(events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), [F.col("user_id"), F.col("ts"), F.col("event_id")], "rank")
    first = numbered.groupBy("user_id").agg(F.min("rank").alias("first"))
    placed = attach_by_key(numbered, first, ["user_id"]).select(
        F.col("user_id").cast("int").alias("subject"), (3 + F.col("user_id") % 12).cast("int").alias("run"),
        (F.col("rank") - F.col("first")).alias("place"), F.array("value").alias("values"),
    )
    notes = spark.createDataFrame([], "subject int, run int, onset double, duration double, code string")
    path = scratch_path(spark, "binary")
    # Steps of 0.01, more than the range of the values.
    recordings.write_recordings(placed, notes, path, 1, -327.68, 327.67)
    scanned = recordings.scan(spark, path).where(F.col("run").isin(*RUNS))
    return scanned.select("subject", "run", rounded("t", "t"), F.round(F.get("values", F.lit(0)), 2).alias("value"))


def stamped_names(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.concat(F.lit("output/NN_"), run_stamp(F.col("ts"))).alias("name"))


def _consonants(texts: pd.Series) -> pd.Series:
    return texts.str.count("[^aeiou ]")


def row_function(spark, sf_dir):
    """A user's own vectorised function on a column."""
    return documents(spark, sf_dir).select("doc_id", models.apply_series(F.col("text"), _consonants, "long").alias("n"))


def single_sentence(spark, sf_dir):
    """One literal sentence through the encoding and model of the whole table."""
    one = files.single_text(spark, SENTENCE, "doc_id", "text")
    return tweets.classify(
        one, "doc_id", "text", "predicted", _frequent_vocabulary(spark, sf_dir), _make_id_toy, length=ENCODED_LENGTH, unknown_id=1
    )


def _arriving(spark, rows):
    """The rows as eight files that a stream takes three at a time."""
    path = scratch_path(spark, "arriving")
    rows.repartition(8, "doc_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)


def stream_mean_vector(spark, sf_dir):
    stored = settle(word_vectors(spark, sf_dir))
    out, progress = scratch_path(spark, "means"), scratch_path(spark, "progress")
    stream = _arriving(spark, documents(spark, sf_dir))
    lookup_stream.mean_vector_stream(stream, "doc_id", "text", stored, DIM, out, progress).awaitTermination()
    schema = StructType.fromDDL("doc_id long, n_tokens long, vector array<double>")
    found = batch_files.read(spark, out, progress, schema)
    return vectors.exploded(found, "doc_id").select("doc_id", "k", rounded("value", "value"))


def stream_label_conflicts(spark, sf_dir):
    rows = tweets.strip_noise(disagreeing(spark, sf_dir), "text")
    out, progress = scratch_path(spark, "groups"), scratch_path(spark, "progress")
    conflict_stream.keep_groups(_arriving(spark, rows), "doc_id", "text", "label", out, progress).awaitTermination()
    groups = conflict_stream.current_groups(spark, out, progress)
    return conflict_stream.conflicts(rows, groups, "doc_id", "text", "label").select("first_id", "doc_id", "label", "n")


STEP_ORACLES = {
    "stored_mean_vector": ORACLES["sentence_mean_vector"],
    "stream_mean_vector": ORACLES["sentence_mean_vector"],
    "stream_label_conflicts": ORACLES["label_conflicts"],
    "set_label": (
        "SELECT doc_id, CASE WHEN doc_id = (SELECT max(doc_id) FROM labels) THEN 9 ELSE quality END AS label FROM labels"
    ),
    "strict_lookup": (
        f"WITH {WORDS}, {RANKED}, "
        "sums AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings), "
        "known AS (SELECT r.word, s.s FROM ranked r JOIN sums s ON s.vec_id = r.place % (SELECT count(*) FROM embeddings)), "
        "found AS (SELECT w.doc_id, count(*) AS n_tokens, sum(k.s) / count(*) AS total FROM words w JOIN known k USING (word) GROUP BY w.doc_id) "
        "SELECT d.doc_id, coalesce(f.n_tokens, 0) AS n_tokens, round(coalesce(f.total, 0.0), 6) AS total FROM documents d LEFT JOIN found f USING (doc_id)"
    ),
    "recording_scan": (
        "SELECT printf('S%03d/S%03dR%02d.edf', user_id, user_id, 3 + user_id % 12) AS path, "
        "round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS t, value FROM events "
        f"WHERE event_type = 'view' AND 3 + user_id % 12 IN {RUNS} AND user_id NOT IN ({', '.join(map(str, EXCLUDED_SUBJECTS))})"
    ),
    "binary_recordings": (
        "SELECT user_id::INTEGER AS subject, (3 + user_id % 12)::INTEGER AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS t, "
        f"least(value, 327.67::DOUBLE) AS value FROM events WHERE 3 + user_id % 12 IN {RUNS}"
    ),
    "stamped_names": "SELECT event_id, 'output/NN_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') AS name FROM events",
    "row_function": "SELECT doc_id, length(regexp_replace(text, '[aeiou ]', '', 'g')) AS n FROM documents",
    "single_sentence": (
        f"WITH {ENCODED.replace('FROM documents), placed', 'FROM sentence), placed')} "
        f"SELECT doc_id, list_position(s, list_max(s))::INTEGER - 1 AS predicted FROM (SELECT doc_id, [{ID_SCORES}] AS s FROM ids)"
    ).replace("WITH ", f"WITH sentence AS (SELECT 0 AS doc_id, '{SENTENCE}' AS text), ", 1),
}

STEP_QUERIES = {
    f.__name__: f
    for f in (
        set_label, strict_lookup, recording_scan, binary_recordings, stamped_names, row_function, single_sentence,
        stored_mean_vector, stream_mean_vector, stream_label_conflicts,
    )
}
