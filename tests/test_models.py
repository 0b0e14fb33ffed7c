import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillwave.functions.vectors import argmax
from quillwave.operators import models
from quillwave.operators.metrics import accuracy
from quillwave.plans import sentiment, tweets
from quillwave.sources import files, sinks


@pytest.fixture(scope="module")
def clusters(spark):
    draw = np.random.default_rng(0)
    centres = np.array([[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]])
    data = [(i, (centres[i % 3] + draw.normal(scale=0.5, size=3)).tolist(), i % 3) for i in range(150)]
    return models.with_features(spark.createDataFrame(data, "id int, vector array<double>, label int"))


@pytest.mark.parametrize("name,settings", [("SVM", {"max_iter": 10}), ("NN", {"hidden": (8,), "max_iter": 40})])
def test_fit_save_load_score(clusters, folder, name, settings):
    model = models.fit(clusters, models.make_model(name, 3, 3, **settings))
    sinks.save_model(model, f"{folder}/m")
    scored = models.score(sinks.load_model(f"{folder}/m"), clusters, "id", "label")
    assert accuracy(scored, "prediction", "label").first().accuracy > 0.8
    assert models.score(model, clusters.drop("label"), "id").count() == 150


def test_unknown_model():
    with pytest.raises(KeyError, match="known"):
        models.make_model("GRU", 3, 3)


def test_fourier_features_approach_the_kernel(spark):
    df = spark.createDataFrame([([0.1, 0.4],), ([0.3, -0.2],)], "v array<double>")
    z = np.array([r.z for r in df.select(models.fourier_features(F.col("v"), 2, 4000, 0.7).alias("z")).collect()])
    assert z[0] @ z[1] == pytest.approx(np.exp(-0.7 * (0.2**2 + 0.6**2)), abs=0.05)


def test_user_functions(spark):
    def lengths(s: pd.Series) -> pd.Series:
        return s.str.len()

    df = spark.createDataFrame([(1, "a"), (2, "bcd")], "id int, text string")
    out = df.select(models.apply_series(F.col("text"), lengths, "int").alias("n")).collect()
    assert [r.n for r in out] == [1, 3]


def test_sentence_to_label(spark):
    def make_counter():
        def predict(ids, masks):
            known = ((ids > 1) & (masks == 1)).sum(axis=1)
            return np.stack([np.full(len(ids), 1.5), known], axis=1).astype(float)

        return predict

    vocabulary = spark.createDataFrame([("great", 2), ("movie", 3)], "word string, word_index int")
    for text, label in (("A great movie!", 1), ("A movie", 0), ("", 0)):
        one = files.single_text(spark, text)
        got = tweets.classify(one, "id", "text", "target", vocabulary, make_counter, length=8, unknown_id=1)
        assert [tuple(r) for r in got.collect()] == [(0, label)]


def test_sentiment_job(spark):
    vectors = spark.createDataFrame(
        [("good", [1.0, 0.0]), ("bad", [0.0, 1.0]), ("film", [0.1, 0.1])], "word string, vector array<float>"
    )
    texts = [(i, ["Good, good film", "bad film!"][i % 2], i % 2) for i in range(60)]
    df = spark.createDataFrame(texts, "PhraseId int, Phrase string, Sentiment int")
    model, dev = sentiment.train_and_score(
        df, "PhraseId", "Phrase", "Sentiment", vectors, 2, model="SVM", n_classes=2, max_iter=5
    )
    assert dev.count() == 6 and accuracy(dev, "prediction", "Sentiment").first().accuracy == 1.0
    test = spark.createDataFrame([(100, "a good one"), (101, "bad")], "PhraseId int, Phrase string")
    template = spark.createDataFrame([(101, 2), (100, 2)], "PhraseId int, Sentiment int")
    out = sentiment.predict_submission(model, test, template, "PhraseId", "Phrase", "Sentiment", vectors, 2)
    assert {r.PhraseId: r.Sentiment for r in out.collect()} == {100: 0, 101: 1}

    synonyms = spark.createDataFrame([("film", "movie")], "word string, synonym string")
    train, held = sentiment.augmented_train(df, "PhraseId", "Phrase", "Sentiment", [1, 0], synonyms)
    assert held.count() == 6
    assert train.count() == 54 + train.where("copy = 0 AND Sentiment = 0").count()
    assert train.join(held, "PhraseId").count() == 0


def test_argmax_tie_takes_first(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "s array<double>")
    assert df.select(argmax(F.col("s"))).first()[0] == 0
