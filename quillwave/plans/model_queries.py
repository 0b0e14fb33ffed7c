"""Queries of training, kernel machines, spatial patterns and sub-words, and their SQL.

The SQL follows closed forms: one Adam step from zero weights, votes from
given pair scores, and the two-channel eigenproblem.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.operators import kernel_svm, metrics, models, split, subwords, training, vocabulary
from quillwave.plans import motor_imagery, sentiment
from quillwave.plans.oracles import LABELLED, RANKED, STOP_WORDS, WEIGHTS, WORDS, _listed, _weight, clean
from quillwave.plans.queries import (
    DIM,
    TOY_CLASSES,
    _make_linear_toy,
    _neighbour_synonyms,
    documents,
    embedding_trials,
    labelled,
    rounded,
    table,
    toy_weight,
    word_vectors,
)
from quillwave.session import scratch_path
from quillwave.sources import files, sinks

RATE = 0.05
PIECE_LENGTH = 128
CLASSES = tuple(range(5))


def parts(spark, sf_dir) -> DataFrame:
    """Embeddings of five classes, a tenth of them set aside."""
    stored = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), (F.col("label") % 5).cast("int").alias("label")
    )
    return split.exact_split(stored, "vec_id", 0.1, out="is_dev")


def _one_step(spark, sf_dir) -> training.Training:
    """All train rows in one step of a single layer that starts at zero."""
    rows = parts(spark, sf_dir)
    network = training.Network((DIM, len(CLASSES)))
    return training.train_epochs(
        rows, network, scratch_path(spark, "training"), id_col="vec_id", epochs=1, batch=1 << 40, rate=RATE,
        local_steps=1, weights=np.zeros(network.n_parameters),
    )


def _log(log: DataFrame) -> DataFrame:
    return log.select("epoch", "part", "n", rounded("loss", "loss"), rounded("accuracy", "accuracy"))


def train_one_step(spark, sf_dir):
    return _log(_one_step(spark, sf_dir).log)


def train_epochs(spark, sf_dir):
    """Mini-batches with ReLU layers and dropout; loss and accuracy of both parts after each epoch."""
    network = training.Network((DIM, 64, 32, len(CLASSES)), dropout=0.01)
    done = training.train_epochs(
        parts(spark, sf_dir), network, scratch_path(spark, "training"), id_col="vec_id", epochs=3, batch=64, rate=1e-3
    )
    return _log(done.log)


def trained_submission(spark, sf_dir):
    """Train, score every row with the best state, align with a template, write and read the hand-in."""
    best = _one_step(spark, sf_dir)
    rows = parts(spark, sf_dir)
    scored = training.predicted(rows, best, "vector", "vec_id").withColumnRenamed("prediction", "target")
    template = rows.where("is_dev").select("vec_id", F.lit(0).alias("target"))
    path = scratch_path(spark, "hand-in")
    sinks.write_submission(sinks.align_submission(template, scored, "vec_id", "target"), path, "vec_id", "target")
    return files.read_csv(spark, path, "vec_id long, target int")


def evaluate_parts(spark, sf_dir):
    """Loss and accuracy of train and dev part under the toy model."""
    rows = parts(spark, sf_dir)
    scores = models.batch_scores(_make_linear_toy, F.col("vector"), shapes=[[DIM]])
    scored = rows.withColumn("scores", scores).withColumn("part", F.when(F.col("is_dev"), "dev").otherwise("train"))
    out = metrics.evaluate_parts(scored, "part", "scores", "label")
    return out.select("part", "n", rounded("loss", "loss"), rounded("accuracy", "accuracy"))


def fitted_parts(spark, sf_dir):
    """Train and dev rows, loss and accuracy of a fitted job; the counts are known, the fit isn't."""
    _, scored, log = sentiment.train_and_evaluate(
        labelled(spark, sf_dir), "doc_id", "text", "label", word_vectors(spark, sf_dir), DIM, model="SVM", n_classes=2, max_iter=5
    )
    return log.select("part", "n")


def kernel_svm_votes(spark, sf_dir):
    rows = parts(spark, sf_dir)
    model = kernel_svm.fit(rows.where("NOT is_dev"), DIM, n_features=128, max_iter=10)
    path = scratch_path(spark, "machines")
    model.save(spark, path)
    return kernel_svm.predicted(kernel_svm.PairModel.load(spark, path), rows, "vector", "vec_id", "label", "is_dev")


def toy_pair_model() -> kernel_svm.PairModel:
    """Pair machines with known weights: differences of the toy model's class weights."""
    machines = [
        kernel_svm.Machine(a, b, tuple(toy_weight(a, k) - toy_weight(b, k + 1) for k in range(DIM)), 0.0)
        for a in range(TOY_CLASSES)
        for b in range(a + 1, TOY_CLASSES)
    ]
    return kernel_svm.PairModel(None, DIM, tuple(machines))


def pair_votes(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings")
    return kernel_svm.votes(kernel_svm.pair_scores(toy_pair_model(), stored, "embedding", "vec_id"), "vec_id")


def csp_two_channels(spark, sf_dir):
    """Embeddings as trials of two channels and 32 samples; one pattern from either end."""
    half = DIM // 2
    stored = table(spark, sf_dir, "embeddings").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
    cells = F.array(*[F.get("embedding", c * half + F.col("sample")).cast("double") for c in (0, 1)])
    trials = stored.select(F.col("vec_id").alias("trial"), (F.col("label") % 2).alias("class"), "sample", cells.alias("values"))
    return _features(motor_imagery.csp_features(trials, ["trial"], "class", (0, 1), 1))


def csp_four_classes(spark, sf_dir):
    """Patterns of four classes by joint diagonalisation, and the features of each trial."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), (F.col("label") % 4).alias("class"))
    trials = embedding_trials(spark, sf_dir).drop("class").join(stored, "trial")
    return _features(motor_imagery.csp_features(trials, ["trial"], "class", (0, 1, 2, 3), 1))


def _features(features: DataFrame) -> DataFrame:
    return features.select("trial", "class", F.posexplode("features").alias("k", "value")).select(
        "trial", "class", "k", rounded("value", "value")
    )


def piece_table(spark, sf_dir) -> DataFrame:
    """Pieces from the words that occur five times: heads, tails, single letters, and all frequent words."""
    counts = vocabulary.word_counts(documents(spark, sf_dir), "text").where("n >= 5")
    word = F.col("word")
    inner = F.array(F.concat(F.lit("##"), F.substring(word, -3, 3)))
    letters = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.concat(F.lit("##"), c))
    whole = F.when(F.col("n") >= 20, F.array(word)).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(F.array(F.substring(word, 1, 3), F.substring(word, 1, 1)), inner, letters, whole)
    listed = counts.select(F.explode(pieces).alias("word"))
    return vocabulary.vocabulary_index(listed).select(F.col("word").alias("piece"), (F.col("word_index") + 1).alias("piece_id"))


def encode_subwords(spark, sf_dir):
    encoded = subwords.encode_subwords(
        documents(spark, sf_dir), "doc_id", "text", piece_table(spark, sf_dir), PIECE_LENGTH, unknown_id=1
    )
    return encoded.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda held, x: held + x).alias("n_ids"),
    )


def augmented_train(spark, sf_dir):
    """The dev part is set aside first; only train rows are copied and changed."""
    train, _ = sentiment.augmented_train(
        labelled(spark, sf_dir), "doc_id", "text", "label", WEIGHTS, _neighbour_synonyms(spark, sf_dir), stop_words=STOP_WORDS
    )
    return train.select("doc_id", "copy", F.md5("text").alias("digest"), "label")


# --- SQL ------------------------------------------------------------------

PARTS = (
    "parts AS (SELECT vec_id, embedding, (label % 5)::INTEGER AS label, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) <= "
    "ceil(0.1::DOUBLE * (SELECT count(*) FROM embeddings)) AS is_dev FROM embeddings)"
)
# Gradient of the mean loss at zero weights: the mean of x * (1 / k - [class is c]); offsets have x = 1.
ONE_STEP = (
    f"{PARTS}, inputs AS (SELECT vec_id, label, is_dev, unnest(range({DIM + 1})) AS j, "
    "unnest(list_append(list_transform(embedding, lambda x: x::DOUBLE), 1.0::DOUBLE)) AS x FROM parts), "
    f"classes AS (SELECT unnest(range({len(CLASSES)}))::INTEGER AS c), "
    f"slopes AS (SELECT j, c, avg(x * (1.0::DOUBLE / {len(CLASSES)} - (label = c)::INTEGER)) AS g FROM inputs, classes WHERE NOT is_dev GROUP BY j, c), "
    f"weights AS (SELECT j, c, -{RATE}::DOUBLE * g / (abs(g) + {training.EPSILON}::DOUBLE) AS w FROM slopes), "
    "scored AS (SELECT i.vec_id, any_value(i.label) AS label, any_value(i.is_dev) AS is_dev, w.c, sum(i.x * w.w) AS s "
    "FROM inputs i JOIN weights w USING (j) GROUP BY i.vec_id, w.c), "
    "rows_ AS (SELECT vec_id, any_value(label) AS label, any_value(is_dev) AS is_dev, arg_max(c, s) AS best, "
    "ln(sum(exp(s))) - max(s) FILTER (c = label) AS loss FROM scored GROUP BY vec_id)"
)
TOY = ", ".join(
    f"list_sum(list_transform(range(1, {DIM} + 1), lambda i: embedding[i]::DOUBLE * {_listed([toy_weight(c, k) for k in range(DIM)])}[i]))"
    for c in range(TOY_CLASSES)
)


def _pair_votes() -> str:
    machines = toy_pair_model().machines
    won = ", ".join(
        f"CASE WHEN list_sum(list_transform(range(1, {DIM} + 1), lambda i: embedding[i]::DOUBLE * {_listed(list(m.weights))}[i])) > 0 "
        f"THEN {m.first} ELSE {m.second} END"
        for m in machines
    )
    return (
        f"WITH won AS (SELECT vec_id, unnest([{won}]) AS c FROM embeddings), n AS (SELECT vec_id, c, count(*) AS votes FROM won GROUP BY ALL) "
        "SELECT vec_id, c::INTEGER AS prediction, votes FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, c) = 1"
    )


def _csp_two_channels() -> str:
    """The smaller and larger root of det(A - x (A + B)) = 0, their vectors scaled to w (A + B) w = 1."""
    half = DIM // 2
    return (
        f"WITH cells AS (SELECT vec_id AS trial, label % 2 AS class, unnest(embedding[1:{half}])::DOUBLE AS a, "
        f"unnest(embedding[{half + 1}:{DIM}])::DOUBLE AS b FROM embeddings), "
        "own AS (SELECT class, trial, avg(a) AS a, avg(b) AS b FROM cells GROUP BY ALL), "
        "middle AS (SELECT class, avg(a) AS a, avg(b) AS b FROM own GROUP BY class), "
        "sums AS (SELECT c.class, sum((c.a - m.a) * (c.a - m.a)) AS aa, sum((c.a - m.a) * (c.b - m.b)) AS ab, "
        "sum((c.b - m.b) * (c.b - m.b)) AS bb FROM cells c JOIN middle m USING (class) GROUP BY c.class), "
        "scaled AS (SELECT class, aa / (aa + bb) AS aa, ab / (aa + bb) AS ab, bb / (aa + bb) AS bb FROM sums), "
        "joint_ AS (SELECT p.aa, p.ab, p.bb, p.aa + q.aa AS saa, p.ab + q.ab AS sab, p.bb + q.bb AS sbb "
        "FROM scaled p, scaled q WHERE p.class = 0 AND q.class = 1), "
        "equation AS (SELECT *, saa * sbb - sab * sab AS x2, -(aa * sbb + bb * saa - 2 * ab * sab) AS x1, aa * bb - ab * ab AS x0 FROM joint_), "
        "roots AS (SELECT *, unnest([0, 1])::INTEGER AS k, unnest([(-x1 - sqrt(x1 * x1 - 4 * x2 * x0)) / (2 * x2), "
        "(-x1 + sqrt(x1 * x1 - 4 * x2 * x0)) / (2 * x2)]) AS x FROM equation), "
        "axes AS (SELECT k, -(ab - x * sab) AS u, aa - x * saa AS v, saa, sab, sbb FROM roots), "
        "patterns AS (SELECT k, u, v, u * u * saa + 2 * u * v * sab + v * v * sbb AS norm FROM axes), "
        "energy AS (SELECT c.trial, c.class, p.k, sum((p.u * c.a + p.v * c.b) * (p.u * c.a + p.v * c.b)) / any_value(p.norm) AS e "
        "FROM cells c, patterns p GROUP BY c.trial, c.class, p.k) "
        "SELECT trial, class, k, round(ln(e / sum(e) OVER (PARTITION BY trial)), 6) AS value FROM energy"
    )


PIECES = (
    f"{WORDS}, frequent AS (SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= 5), "
    "listed AS (SELECT substr(word, 1, 3) AS piece FROM frequent UNION SELECT substr(word, 1, 1) FROM frequent "
    "UNION SELECT '##' || right(word, 3) FROM frequent UNION SELECT '##' || unnest(string_split(word, '')) FROM frequent "
    "UNION SELECT word FROM frequent WHERE n >= 20), "
    "pieces AS (SELECT piece, row_number() OVER (ORDER BY piece) + 1 AS id FROM listed)"
)

MODEL_ORACLES = {
    "train_one_step": (
        f"WITH {ONE_STEP} SELECT 1 AS epoch, CASE WHEN is_dev THEN 'dev' ELSE 'train' END AS part, count(*) AS n, "
        "round(avg(loss), 6) AS loss, round(avg((best = label)::INTEGER), 6) AS accuracy FROM rows_ GROUP BY is_dev"
    ),
    "trained_submission": f"WITH {ONE_STEP} SELECT vec_id, best AS target FROM rows_ WHERE is_dev",
    "evaluate_parts": (
        f"WITH {PARTS}, s AS (SELECT is_dev, label, [{TOY}] AS s FROM parts) "
        "SELECT CASE WHEN is_dev THEN 'dev' ELSE 'train' END AS part, count(*) AS n, "
        "round(avg(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[label + 1]), 6) AS loss, "
        "round(avg((list_position(s, list_max(s)) - 1 = label)::INTEGER), 6) AS accuracy FROM s GROUP BY is_dev"
    ),
    "fitted_parts": (
        f"WITH {LABELLED} SELECT unnest(['dev', 'train']) AS part, unnest([ceil(0.1::DOUBLE * count(*))::BIGINT, "
        "count(*) - ceil(0.1::DOUBLE * count(*))::BIGINT]) AS n FROM labelled"
    ),
    "pair_votes": _pair_votes(),
    "csp_two_channels": _csp_two_channels(),
    "encode_subwords": (
        f"WITH RECURSIVE {PIECES}, "
        f"texts AS (SELECT doc_id, list_filter(string_split({clean('text')}, ' '), lambda w: w <> '')[1:{PIECE_LENGTH}] AS w FROM documents), "
        "placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM texts), "
        "distinct_ AS (SELECT DISTINCT word FROM placed), "
        "starts AS (SELECT word, unnest(range(length(word))) AS spot FROM distinct_ WHERE length(word) <= 100), "
        "spans AS (SELECT word, spot, unnest(range(1, least(length(word) - spot, (SELECT max(length(piece)) FROM pieces)) + 1)) AS size FROM starts), "
        "best AS (SELECT s.word, s.spot, max(s.size) AS size, arg_max(p.id, s.size) AS id FROM spans s "
        "JOIN pieces p ON p.piece = CASE WHEN s.spot = 0 THEN '' ELSE '##' END || substr(s.word, s.spot + 1, s.size) GROUP BY s.word, s.spot), "
        "walk AS (SELECT word, 0::BIGINT AS spot, []::BIGINT[] AS ids FROM distinct_ UNION ALL "
        "SELECT w.word, w.spot + b.size, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.spot = w.spot), "
        "coded AS (SELECT d.word, coalesce(w.ids, [1]) AS ids FROM distinct_ d LEFT JOIN walk w ON w.word = d.word AND w.spot = length(w.word)), "
        "joined AS (SELECT p.doc_id, flatten(list(c.ids ORDER BY p.pos)) AS ids FROM placed p JOIN coded c USING (word) GROUP BY p.doc_id), "
        f"ids AS (SELECT t.doc_id, coalesce(j.ids, [])[1:{PIECE_LENGTH}] AS ids FROM texts t LEFT JOIN joined j USING (doc_id)) "
        f"SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({PIECE_LENGTH} - len(ids)), lambda i: 0)), ' ') AS input_ids, "
        "len(ids)::INTEGER AS n_ids FROM ids"
    ),
    "augmented_train": (
        f"WITH {LABELLED}, {WORDS}, {RANKED}, "
        "train AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= "
        "ceil(0.1::DOUBLE * (SELECT count(*) FROM labelled)) AS is_dev FROM labelled) WHERE NOT is_dev), "
        "synonyms AS (SELECT a.word, b.word AS synonym FROM ranked a JOIN ranked b ON b.place IN (a.place, a.place + 1)), "
        "dictionary AS (SELECT word, list(DISTINCT synonym ORDER BY synonym) AS options FROM synonyms GROUP BY word), "
        f"every AS (SELECT doc_id, text, label, unnest(range({_weight('label')} + 1)) AS copy FROM train), "
        "candidates AS (SELECT DISTINCT doc_id, copy, word FROM "
        "(SELECT doc_id, copy, unnest(string_split(text, ' ')) AS word FROM every WHERE copy > 0) "
        f"WHERE NOT list_contains({_listed(STOP_WORDS)}, word)), "
        "drawn AS (SELECT c.*, d.options, md5('42:' || c.doc_id || ':' || c.copy || ':' || c.word) AS key "
        "FROM candidates c JOIN dictionary d USING (word)), "
        "chosen AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY doc_id, copy ORDER BY key, word) <= 5), "
        "swaps AS (SELECT doc_id, copy, map(list(word), list(options[1 + (('0x' || substr(key, 1, 8))::BIGINT % len(options))])) AS swap "
        "FROM chosen GROUP BY ALL) "
        "SELECT e.doc_id, e.copy::INTEGER AS copy, md5(CASE WHEN s.swap IS NULL THEN e.text ELSE array_to_string(list_transform("
        "string_split(e.text, ' '), lambda w: coalesce(s.swap[w], w)), ' ') END) AS digest, e.label "
        "FROM every e LEFT JOIN swaps s USING (doc_id, copy)"
    ),
}

MODEL_QUERIES = {
    function.__name__: function
    for function in (
        train_one_step, train_epochs, trained_submission, evaluate_parts, fitted_parts, kernel_svm_votes, pair_votes,
        csp_two_channels, csp_four_classes, encode_subwords, augmented_train,
    )
}
