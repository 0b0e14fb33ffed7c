import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillwave.operators.labels import duplicate_rows, label_conflicts
from quillwave.operators.vectors import mean_vectors
from quillwave.plans import tweets
from quillwave.streaming import batch_files, conflict_stream, lookup_stream

TEXTS = [(i, ["good film", "bad film, bad", "unseen", "", "good"][i % 5], i % 3) for i in range(40)]
SCHEMA = "id long, text string, label int"


@pytest.fixture()
def source(spark, folder):
    """Files that arrive one after another."""

    def arrive(number, some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={number}")

    def stream(files=1):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{folder}/in")

    return arrive, stream


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([("good", [1.0, 0.0]), ("bad", [0.0, 2.0]), ("film", [1.0, 1.0])], "word string, vector array<float>")


def test_mean_vectors_also_after_a_failure(spark, folder, source, vectors):
    arrive, stream = source
    for k in range(4):
        arrive(k, TEXTS[k * 10 : (k + 1) * 10])
    out, progress = f"{folder}/out", f"{folder}/progress"
    tries = []

    def fails_once(batch):
        found = mean_vectors(batch, "id", "text", vectors, 2)
        tries.append(1)
        if len(tries) == 3:
            # Leave files of an unfinished batch behind.
            found.write.mode("overwrite").parquet(f"{out}/batch=2")
            raise RuntimeError("lost")
        return found

    with pytest.raises(Exception, match="lost"):
        batch_files.start(stream(), fails_once, out, progress).awaitTermination()
    schema = mean_vectors(spark.createDataFrame([], SCHEMA), "id", "text", vectors, 2).schema
    assert batch_files.committed(spark, progress) == [0, 1]
    assert batch_files.read(spark, out, progress, schema).count() == 20
    lookup_stream.mean_vector_stream(stream(), "id", "text", vectors, 2, out, progress).awaitTermination()
    got = batch_files.read(spark, out, progress, schema)
    assert rows(got, "id", "n_tokens", "vector") == rows(mean_vectors(spark.createDataFrame(TEXTS, SCHEMA), "id", "text", vectors, 2))
    # Nothing new: nothing changes.
    lookup_stream.mean_vector_stream(stream(), "id", "text", vectors, 2, out, progress).awaitTermination()
    assert batch_files.read(spark, out, progress, schema).count() == 40


def test_classes(spark, folder, source):
    import numpy as np

    def make():
        return lambda ids, masks: np.stack([masks.sum(axis=1), ids.max(axis=1)], axis=1).astype(float)

    arrive, stream = source
    arrive(0, TEXTS[:25])
    arrive(1, TEXTS[25:])
    vocabulary = spark.createDataFrame([("good", 2), ("film", 3)], "word string, word_index int")
    out, progress = f"{folder}/out", f"{folder}/progress"
    lookup_stream.classify_stream(stream(), "id", "text", "target", vocabulary, make, out, progress, length=6).awaitTermination()
    want = tweets.classify(spark.createDataFrame(TEXTS, SCHEMA), "id", "text", "target", vocabulary, make, length=6)
    assert rows(batch_files.read(spark, out, progress, want.schema), "id", "target") == rows(want)


@pytest.mark.parametrize("cuts", [[40], [1, 7, 8, 30, 40], [20, 40]])
def test_conflicts_after_any_cut(spark, folder, source, cuts):
    arrive, stream = source
    out, progress = f"{folder}/out", f"{folder}/progress"
    # Late rows have smaller ids, so first ids and verdicts are corrected.
    order = TEXTS[::-1]
    begin = 0
    for number, end in enumerate(cuts):
        arrive(number, order[begin:end])
        begin = end
        conflict_stream.keep_groups(stream(), "id", "text", "label", out, progress).awaitTermination()
    groups = conflict_stream.current_groups(spark, out, progress)
    every = spark.createDataFrame(TEXTS, SCHEMA)
    want = label_conflicts(every, "id", "text", "label")
    assert rows(conflict_stream.conflicts(every, groups, "id", "text", "label"), *want.columns) == rows(want)
    assert rows(conflict_stream.repeated(every, groups, "id"), "id") == rows(duplicate_rows(every, "id", "text"), "id")
    assert groups.count() == 5


def test_no_batch_yet(spark, folder):
    assert conflict_stream.current_groups(spark, f"{folder}/out", f"{folder}/progress").count() == 0


def test_rows_are_combined_before_the_shuffle(spark):
    text = conflict_stream.group_state(spark.createDataFrame(TEXTS, SCHEMA), "id", "text", "label")._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_count") > text.index("Exchange")
