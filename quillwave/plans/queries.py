"""One query per operator over the test tables.

Every function takes the session and the folder of the tables and reads whole
tables. Floats are rounded to 6 places so that the order of summation does not
show.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.functions import text as tx
from quillwave.functions import vectors as vx
from quillwave.operators import augment, labels, metrics, models, sequences, split, trials, vectors, vocabulary
from quillwave.operators.filters import filter_recordings, gather_series, zero_phase
from quillwave.operators.ranking import global_rank
from quillwave.plans import motor_imagery, sentiment, tweets
from quillwave.session import scratch_path
from quillwave.sources import files, sinks
from quillwave.streaming import text_stream

DIM = 64
CHANNELS = 8
SAMPLES = 8
ENCODED_LENGTH = 512
KEYWORDS = ["the", "and", "of", "que", "le", "un", "is", "der"]
STOP_WORDS = ["the", "and", "of", "to", "is", "le", "la", "de", "que", "der", "die", "el"]
# Copies of each class.
WEIGHTS = [3, 1, 0, 1, 3]
TOY_CLASSES = 5
FILTER_B = [0.2, 0.3, 0.2]
FILTER_A = [1.0, -0.4, 0.1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def rounded(column: str | Column, name: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``quality`` as label."""
    quality = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(quality, "doc_id")


def disagreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents where every third label is flipped."""
    flipped = F.when(F.col("doc_id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label"))
    return labelled(spark, sf_dir).withColumn("label", flipped)


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, vector)``: the i-th most frequent word has vector i - 1."""
    ranked = vocabulary.frequency_rank(vocabulary.word_counts(documents(spark, sf_dir), "text"))
    stored = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") + 1).alias("place"), F.col("embedding").alias("vector")
    )
    return ranked.join(stored, "place").select("word", "vector")


def embedding_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as trials: number k is channel k div 8, sample k mod 8."""
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(CHANNELS - 1)),
        lambda channel: F.get("embedding", channel * SAMPLES + F.col("sample")).cast("double"),
    )
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
        .select(F.col("vec_id").alias("trial"), (F.col("label") % 2).alias("class"), "sample", cells.alias("values"))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# --- text ---------------------------------------------------------------


def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("clean_text"))


def stream_clean_text(spark, sf_dir):
    stored = f"{sf_dir}/documents.parquet"
    stream = text_stream.read_table_stream(spark, stored, spark.read.parquet(stored).schema)
    path = scratch_path(spark, "clean")
    text_stream.run_available(text_stream.clean_stream(stream, "text").select("doc_id", "clean_text"), path)
    return spark.read.schema("doc_id long, clean_text string").parquet(path)


def strip_noise_tokens(spark, sf_dir):
    noisy = F.concat(F.lit("#t "), F.col("text"), F.lit(" @u - http://x https://y -z"))
    return documents(spark, sf_dir).select("doc_id", tx.strip_noise_tokens(noisy).alias("stripped"))


def tokens_single_space(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(tx.split_single_space(F.col("text"))).alias("pos", "token")
    )


# --- labels -------------------------------------------------------------


def class_counts(spark, sf_dir):
    return labels.class_counts(events(spark, sf_dir), "event_type").orderBy(F.col("n").desc(), "event_type")


def class_shares(spark, sf_dir):
    shares = labels.class_shares(table(spark, sf_dir, "labels"), "quality")
    return shares.select("quality", "n", rounded("share", "share"))


def first_rows(spark, sf_dir):
    return labels.first_rows(table(spark, sf_dir, "labels"), "doc_id", 10)


def duplicate_rows(spark, sf_dir):
    stripped = tweets.strip_noise(documents(spark, sf_dir), "text")
    return labels.duplicate_rows(stripped, "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def label_conflicts(spark, sf_dir):
    return tweets.audit(disagreeing(spark, sf_dir), "doc_id", "text", "label").select(
        "first_id", "doc_id", "label", "n"
    )


def label_corrections(spark, sf_dir):
    return tweets.equal_labels(disagreeing(spark, sf_dir), "doc_id", "text", "label").select("doc_id", "label")


# --- words and vectors --------------------------------------------------


def vocabulary_rank(spark, sf_dir):
    words = vectors.text_words(documents(spark, sf_dir), "text")
    return vocabulary.vocabulary_index(words)


def word_vector_scan(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    # Each word twice, first with zeros: the later line has to win.
    twice = stored.withColumn("factor", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).select(
        F.concat(F.lit("w"), F.col("vec_id")).alias("word"),
        vx.scale(F.col("embedding"), F.col("factor").cast("float")).alias("vector"),
    )
    path = scratch_path(spark, "vectors")
    sinks.write_word_vectors(twice, path)
    scanned = files.read_word_vectors(spark, path)
    return vectors.exploded(scanned, "word").select("word", "k", F.col("value").cast("double").alias("value"))


def _mean_vectors(spark, sf_dir, vector_table=None):
    stored = word_vectors(spark, sf_dir) if vector_table is None else vector_table
    return vectors.mean_vectors(documents(spark, sf_dir), "doc_id", "text", stored, DIM)


def _long(df: DataFrame) -> DataFrame:
    return vectors.exploded(df, "doc_id").select("doc_id", "k", rounded("value", "value"))


def sentence_mean_vector(spark, sf_dir):
    return _long(_mean_vectors(spark, sf_dir))


def unknown_words(spark, sf_dir):
    return vectors.unknown_words(documents(spark, sf_dir), "text", word_vectors(spark, sf_dir))


def word_class_counts(spark, sf_dir):
    return vocabulary.word_class_counts(labelled(spark, sf_dir), "text", "label")


def _salient(spark, sf_dir):
    return vocabulary.salient_words(
        word_class_counts(spark, sf_dir), "label", [0, 1], min_count=5, min_lift=1.5
    )


def salient_words(spark, sf_dir):
    return _salient(spark, sf_dir).select("word", "label", "n", "word_n", rounded("lift", "lift"))


def salient_weighted_vector(spark, sf_dir):
    chosen = _salient(spark, sf_dir).select("word").distinct()
    return _long(_mean_vectors(spark, sf_dir, vectors.reweighted(word_vectors(spark, sf_dir), chosen, 2.0)))


def keyword_features(spark, sf_dir):
    features = _mean_vectors(spark, sf_dir)
    return _long(
        vectors.with_keyword_indicators(documents(spark, sf_dir), "doc_id", "text", features, KEYWORDS)
    )


def _frequent_vocabulary(spark, sf_dir):
    """Index of the words that occur at least twice; ids 0 and 1 stay free."""
    counts = vocabulary.word_counts(documents(spark, sf_dir), "text").where(F.col("n") >= 2)
    return vocabulary.vocabulary_index(counts).withColumn("word_index", F.col("word_index") + 1)


def encode_fixed_length(spark, sf_dir):
    encoded = vocabulary.encode_fixed_length(
        documents(spark, sf_dir), "doc_id", "text", _frequent_vocabulary(spark, sf_dir), ENCODED_LENGTH, unknown_id=1
    )
    return encoded.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


# --- splits and augmentation ---------------------------------------------


def exact_split_dev(spark, sf_dir):
    return split.exact_split(documents(spark, sf_dir).select("doc_id"), "doc_id", 0.1, seed=42, out="is_dev")


def exact_split_99(spark, sf_dir):
    return split.exact_split(
        documents(spark, sf_dir).select("doc_id"), "doc_id", 0.99, seed=7, round_up=False, out="is_train"
    )


def shuffle_positions(spark, sf_dir):
    keyed = documents(spark, sf_dir).select("doc_id", tx.repeatable_key(42, F.col("doc_id")).alias("key"))
    return global_rank(keyed, [F.col("key"), F.col("doc_id")], "place").select("doc_id", "place")


def oversample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return split.oversample(rows, "label", WEIGHTS)


def _neighbour_synonyms(spark, sf_dir):
    """Each word stands for itself and for the next less frequent word."""
    ranked = vocabulary.frequency_rank(vocabulary.word_counts(documents(spark, sf_dir), "text"))
    following = ranked.select((F.col("place") - 1).alias("place"), F.col("word").alias("synonym"))
    return ranked.join(following, "place").select("word", "synonym").unionByName(
        ranked.select("word", F.col("word").alias("synonym"))
    )


def synonym_augment(spark, sf_dir):
    return augment.synonym_augment(
        labelled(spark, sf_dir), "doc_id", "text", "label", WEIGHTS,
        _neighbour_synonyms(spark, sf_dir), stop_words=STOP_WORDS, n_words=5, seed=42,
    )


# --- metrics and models ---------------------------------------------------


def argmax_label(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    return stored.select("vec_id", vx.argmax(F.col("embedding")).alias("predicted"))


def accuracy(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").withColumn("predicted", vx.argmax(F.col("embedding")))
    return metrics.accuracy(stored, "predicted", "label").select(rounded("accuracy", "accuracy"), "n")


def cross_entropy(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    return metrics.mean_cross_entropy(stored, "embedding", "label").select(rounded("loss", "loss"), "n")


def _epoch_log(spark, sf_dir):
    """Events as a training log: user = run, day = epoch, event = batch."""
    batches = events(spark, sf_dir).select(
        "user_id",
        F.datediff("ts", F.lit("2024-01-01")).alias("epoch"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "train").otherwise("dev").alias("part"),
        F.log1p("value").alias("batch_loss"),
        F.lit(2).alias("batch_rows"),
        (F.col("event_id") % 3).alias("batch_correct"),
    )
    return metrics.epoch_log(batches, ["user_id", "epoch", "part"])


def _dev_log(spark, sf_dir):
    return _epoch_log(spark, sf_dir).where("part = 'dev'").select(
        "user_id",
        "epoch",
        F.concat(F.lit("m"), F.col("epoch")).alias("model"),
        rounded("mean_loss", "dev_loss"),
    )


def epoch_log(spark, sf_dir):
    return _epoch_log(spark, sf_dir).select(
        "user_id", "epoch", "part", "n_batches", "n_rows",
        rounded("loss_per_row", "loss_per_row"), rounded("mean_loss", "mean_loss"), rounded("accuracy", "accuracy"),
    )


def best_checkpoint(spark, sf_dir):
    return metrics.best_checkpoint(_dev_log(spark, sf_dir), ["user_id"], "model", "dev_loss", "epoch")


def running_best(spark, sf_dir):
    weekly = F.floor(F.col("epoch") / 7)
    return metrics.running_best(_dev_log(spark, sf_dir), ["user_id"], "epoch", "dev_loss", weekly)


def _embedding_parts(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), (F.col("label") % 5).alias("label")
    )
    return split.exact_split(models.with_features(stored), "vec_id", 0.1, out="is_dev")


def svm_classify(spark, sf_dir):
    parts = _embedding_parts(spark, sf_dir)
    fitted = models.fit(parts.where("NOT is_dev"), models.make_model("SVM", DIM, 5, max_iter=10))
    return models.score(fitted, parts, "vec_id", "label", "is_dev")


def mlp_classify(spark, sf_dir):
    """Also writes the model and scores with the one read back."""
    parts = _embedding_parts(spark, sf_dir)
    path = scratch_path(spark, "model")
    sinks.save_model(models.fit(parts.where("NOT is_dev"), models.make_model("NN", DIM, 5, hidden=(32,))), path)
    return models.score(sinks.load_model(path), parts, "vec_id", "label", "is_dev")


def fit_and_score(spark, sf_dir):
    _, scored = sentiment.train_and_score(
        labelled(spark, sf_dir), "doc_id", "text", "label", word_vectors(spark, sf_dir), DIM,
        model="SVM", n_classes=2, max_iter=10,
    )
    return scored


def toy_weight(label: int, k: int) -> float:
    return ((label * 31 + k * 17) % 11 - 5) / 10


def _make_linear_toy():
    weights = np.array([[toy_weight(c, k) for k in range(DIM)] for c in range(TOY_CLASSES)])

    def predict(batch):
        return batch.astype(np.float64) @ weights.T

    return predict


def udf_predict(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    scores = models.batch_scores(_make_linear_toy, F.col("embedding"), shapes=[[DIM]])
    return stored.select("vec_id", scores.alias("scores")).select("vec_id", vx.argmax(F.col("scores")).alias("predicted"))


def _make_id_toy():
    def predict(ids, masks):
        ids = ids.astype(np.int64)
        return np.stack([((ids * (c + 1)) % 7 * masks).sum(axis=1) for c in range(3)], axis=1).astype(float)

    return predict


def encoded_text_label(spark, sf_dir):
    return tweets.classify(
        documents(spark, sf_dir), "doc_id", "text", "predicted",
        _frequent_vocabulary(spark, sf_dir), _make_id_toy, length=ENCODED_LENGTH, unknown_id=1,
    )


# --- files ----------------------------------------------------------------


def submission_align(spark, sf_dir):
    predicted = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("target")
    )
    template = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("target"))
    path = scratch_path(spark, "submission")
    sinks.write_submission(sinks.align_submission(template, predicted, "doc_id", "target"), path, "doc_id", "target")
    return files.read_csv(spark, path, "doc_id long, target int")


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.write_delimited(documents(spark, sf_dir), path)
    back = files.read_csv(spark, path, "doc_id long, text string")
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def tsv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    sinks.write_delimited(clean_text(spark, sf_dir), path, sep="\t")
    return files.read_tsv(spark, path, "doc_id long, clean_text string")


# --- signals --------------------------------------------------------------


def asof_label(spark, sf_dir):
    every = events(spark, sf_dir)
    samples = every.where("event_type = 'view'").select("event_id", "user_id", "ts")
    notes = every.where("event_type = 'signup'").select(
        "user_id", "ts", F.concat(F.lit("A"), F.col("event_id")).alias("code")
    )
    return sequences.label_samples(
        samples, notes, ["user_id"], time_col="ts", onset_col="ts", code_col="code", chunk=F.to_date
    ).select("event_id", "user_id", "code")


def _event_runs(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return sequences.mark_runs(rows, ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts"))


def marker_runs(spark, sf_dir):
    return sequences.run_lengths(_event_runs(spark, sf_dir), ["user_id"], "event_type")


def first_n_of_run(spark, sf_dir):
    return sequences.first_of_runs(_event_runs(spark, sf_dir), ["user_id"], 0, 3).select(
        "event_id", "user_id", "run_start", "sample"
    )


def _event_recordings(spark, sf_dir):
    """Views as samples, other events as annotations; one recording per user."""
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1000000D")
    every = events(spark, sf_dir).select(
        F.col("user_id").alias("subject"),
        (3 + F.col("user_id") % 12).cast("int").alias("run"),
        seconds.alias("t"),
        "event_type",
        F.array(F.col("value")).alias("values"),
    )
    code = F.when(F.col("event_type") == "click", "T1").when(F.col("event_type") == "purchase", "T2").otherwise("T0")
    samples = every.where("event_type = 'view'").select("subject", "run", "t", "values")
    notes = every.where("event_type <> 'view'").select(
        "subject", "run", F.col("t").alias("onset"), F.lit(3600.0).alias("duration"), code.alias("code")
    )
    return samples, notes


def trial_segments(spark, sf_dir):
    samples, notes = _event_recordings(spark, sf_dir)
    cut = motor_imagery.segment(
        samples, notes, time_range=(0, 2), sample_rate=1, chunk=lambda t: F.floor(t / 86400)
    )
    return cut.select("subject", "run", "trial", "task", "sample", F.get("values", F.lit(0)).alias("value"))


def run_task_class(spark, sf_dir):
    marker = F.when(F.col("event_type") == "view", "T1").when(F.col("event_type") == "click", "T2").otherwise("T0")
    rows = events(spark, sf_dir).select(
        "event_id", (3 + F.col("user_id") % 12).cast("int").alias("run"), marker.alias("marker")
    )
    return trials.with_task_class(rows).select("event_id", "run", "marker", "task")


def exclude_keys(spark, sf_dir):
    return trials.exclude_keys(events(spark, sf_dir), "user_id").select("event_id", "user_id")


def zscore(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    return trials.zscore(rows, ["event_type"], "value").select(
        "event_id", "event_type", rounded("z", "z")
    )


def channel_center(spark, sf_dir):
    centred = trials.centre_channels(embedding_trials(spark, sf_dir), ["trial"], "class")
    return trials.to_long(centred).select("trial", "class", "sample", "channel", rounded("value", "value"))


def class_covariance(spark, sf_dir):
    return trials.class_covariance(embedding_trials(spark, sf_dir), "class").select(
        "class", "i", "j", rounded("value", "value")
    )


def log_variance(spark, sf_dir):
    features = trials.log_variance(embedding_trials(spark, sf_dir), ["trial"], CHANNELS)
    return features.select("trial", F.posexplode("features").alias("k", "value")).select(
        "trial", "k", rounded("value", "value")
    )


def csp_features(spark, sf_dir):
    features = motor_imagery.csp_features(embedding_trials(spark, sf_dir), ["trial"], "class", (0, 1), 2)
    return features.select("trial", "class", F.posexplode("features").alias("k", "value")).select(
        "trial", "class", "k", rounded("value", "value")
    )


def iir_filter(spark, sf_dir):
    long = trials.to_long(embedding_trials(spark, sf_dir)).select("trial", "channel", "sample", "value")
    filtered = gather_series(long, ["trial", "channel"]).withColumn(
        "series", zero_phase(F.col("series"), FILTER_B, FILTER_A)
    )
    return filtered.select("trial", "channel", F.posexplode("series").alias("sample", "value")).select(
        "trial", "channel", "sample", rounded("value", "value")
    )


def filter_whole_recordings(spark, sf_dir):
    """Values of each user in time order as one long series, cut by week."""
    rows = events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    done = filter_recordings(rows, ["user_id"], "at", "value", F.trunc("at.ts", "week"), FILTER_B, FILTER_A)
    return done.select(F.col("at.event_id").alias("event_id"), "user_id", rounded("filtered", "filtered"))


QUERIES = {
    function.__name__: function
    for function in (
        clean_text, stream_clean_text, strip_noise_tokens, tokens_single_space,
        class_counts, class_shares, first_rows, duplicate_rows, label_conflicts, label_corrections,
        vocabulary_rank, word_vector_scan, sentence_mean_vector, unknown_words,
        word_class_counts, salient_words, salient_weighted_vector, keyword_features, encode_fixed_length,
        exact_split_dev, exact_split_99, shuffle_positions, oversample, synonym_augment,
        argmax_label, accuracy, cross_entropy, epoch_log, best_checkpoint, running_best,
        svm_classify, mlp_classify, fit_and_score, udf_predict, encoded_text_label,
        submission_align, csv_round_trip, tsv_round_trip,
        asof_label, marker_runs, first_n_of_run, trial_segments, run_task_class, exclude_keys,
        zscore, channel_center, class_covariance, log_variance, csp_features, iir_filter, filter_whole_recordings,
    )
}
