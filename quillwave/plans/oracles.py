"""The same queries as SQL, for the check against another engine."""

from __future__ import annotations

from quillwave.functions.text import PUNCTUATION
from quillwave.operators.trials import EXCLUDED_SUBJECTS, FIST_FEET_RUNS, LEFT_RIGHT_RUNS
from quillwave.plans.queries import (
    CHANNELS,
    DIM,
    ENCODED_LENGTH,
    FILTER_A,
    FILTER_B,
    KEYWORDS,
    SAMPLES,
    STOP_WORDS,
    TOY_CLASSES,
    WEIGHTS,
    toy_weight,
)

# Whitespace as a pattern: the class of separators, and control characters.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(items) -> str:
    return "[" + ", ".join(_quoted(i) if isinstance(i, str) else str(i) for i in items) + "]"


def clean(text: str) -> str:
    bare = f"translate(lower({text}), {_quoted(PUNCTUATION)}, '')"
    return f"trim(regexp_replace({bare}, {_quoted(WHITESPACE)}, ' ', 'g'))"


def strip_noise(text: str) -> str:
    items = f"string_split_regex({text}, {_quoted(WHITESPACE)})"
    wanted = "w <> '' AND w[1] <> '#' AND w[1] <> '@' AND w <> '-' AND NOT contains(w, 'http://')"
    return f"array_to_string(list_filter({items}, lambda w: {wanted}), ' ')"


def _words(source: str, keep: str) -> str:
    """Rows of ``source`` as one row per word."""
    return (
        f"SELECT * FROM (SELECT {keep}, unnest(string_split({clean('text')}, ' ')) AS word FROM {source}) WHERE word <> ''"
    )


LABELLED = "labelled AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
DISAGREEING = (
    "rows_ AS (SELECT d.doc_id, " + strip_noise("d.text") + " AS text, "
    "CASE WHEN d.doc_id % 3 = 0 THEN 1 - l.quality ELSE l.quality END AS label "
    "FROM documents d JOIN labels l USING (doc_id)), "
    "groups_ AS (SELECT text, min(doc_id) AS first_id, count(*) AS n, arg_min(label, doc_id) AS first_label "
    "FROM rows_ GROUP BY text HAVING count(*) > 1 AND min(label) <> max(label))"
)
WORDS = f"words AS ({_words('documents', 'doc_id')})"
RANKED = (
    "counts AS (SELECT word, count(*) AS n FROM words GROUP BY word), "
    "ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS place FROM counts)"
)
VECTORS = "vectors AS (SELECT r.word, e.embedding AS vector FROM ranked r JOIN embeddings e ON e.vec_id = r.place - 1)"
SALIENT = (
    f"{LABELLED}, lwords AS ({_words('labelled', 'doc_id, label')}), "
    "pairs AS (SELECT word, label, count(*) AS n FROM lwords GROUP BY ALL), "
    "per_class AS (SELECT label, sum(n)::DOUBLE AS class_n FROM pairs GROUP BY label), "
    "scored AS (SELECT p.word, p.label, p.n, sum(p.n) OVER (PARTITION BY p.word) AS word_n, c.class_n, "
    "(SELECT sum(n) FROM pairs)::DOUBLE AS all_n FROM pairs p JOIN per_class c USING (label)), "
    "salient AS (SELECT word, label, n, word_n::BIGINT AS word_n, (n::DOUBLE / word_n) / (class_n / all_n) AS lift "
    "FROM scored WHERE word_n >= 5 AND (n::DOUBLE / word_n) / (class_n / all_n) >= 1.5)"
)


def _mean(vector: str = "v.vector[k + 1]::DOUBLE") -> str:
    """CTEs ending in ``mean(doc_id, k, value)``; needs words and vectors."""
    return (
        "bags AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL), "
        "sizes AS (SELECT doc_id, sum(n) AS tokens FROM bags GROUP BY doc_id), "
        f"dims AS (SELECT unnest(range({DIM}))::INTEGER AS k), "
        f"sums AS (SELECT b.doc_id, k, sum(b.n * {vector}) AS total FROM bags b JOIN vectors v USING (word), dims "
        "GROUP BY ALL), "
        "mean AS (SELECT d.doc_id, dims.k, coalesce(s.total / z.tokens, 0.0) AS value FROM documents d CROSS JOIN dims "
        "LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.k = dims.k LEFT JOIN sizes z ON z.doc_id = d.doc_id)"
    )


FREQUENT = (
    "vocab AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM "
    "(SELECT word FROM words GROUP BY word HAVING count(*) >= 2))"
)
ENCODED = (
    f"{WORDS}, {FREQUENT}, "
    f"texts AS (SELECT doc_id, list_filter(string_split({clean('text')}, ' '), lambda w: w <> '')[1:{ENCODED_LENGTH}] AS w "
    "FROM documents), "
    "placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM texts), "
    "coded AS (SELECT p.doc_id, p.pos, coalesce(v.id, 1) AS id FROM placed p LEFT JOIN vocab v USING (word)), "
    "ids AS (SELECT t.doc_id, coalesce(g.ids, []) AS ids FROM texts t LEFT JOIN "
    "(SELECT doc_id, list(id ORDER BY pos) AS ids FROM coded GROUP BY doc_id) g USING (doc_id))"
)


def _split(name: str, seed: int, cut: str) -> str:
    return (
        f"SELECT doc_id, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) <= {cut} AS {name} "
        "FROM documents"
    )


def _weight(label: str) -> str:
    return f"coalesce({_listed(WEIGHTS)}[{label} + 1], 0)"


EPOCHS = (
    "batches AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch, "
    "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'train' ELSE 'dev' END AS part, "
    "ln(1 + value) AS batch_loss, 2 AS batch_rows, event_id % 3 AS batch_correct FROM events), "
    "log AS (SELECT user_id, epoch, part, count(*) AS n_batches, sum(batch_rows)::BIGINT AS n_rows, "
    "sum(batch_loss) / sum(batch_rows) AS loss_per_row, avg(batch_loss) AS mean_loss, "
    "sum(batch_correct)::DOUBLE / sum(batch_rows) AS accuracy FROM batches GROUP BY ALL), "
    "dev AS (SELECT user_id, epoch, 'm' || epoch AS model, round(mean_loss, 6) AS dev_loss FROM log WHERE part = 'dev')"
)

RUNS = (
    "flagged AS (SELECT *, row_number() OVER w AS position, "
    "CASE WHEN marker IS DISTINCT FROM lag(marker) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS change "
    "FROM source WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "numbered AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY position) AS run FROM flagged), "
    "marked AS (SELECT *, min(position) OVER (PARTITION BY user_id, run) AS run_start, "
    "count(*) OVER (PARTITION BY user_id, run) AS run_n FROM numbered)"
)
EVENT_RUNS = f"source AS (SELECT event_id, user_id, ts, event_type AS marker FROM events), {RUNS}"


def _task(run: str, marker: str) -> str:
    left_right = f"{run} IN ({', '.join(map(str, LEFT_RIGHT_RUNS))})"
    fist_feet = f"{run} IN ({', '.join(map(str, FIST_FEET_RUNS))})"
    return (
        f"CASE WHEN {left_right} AND {marker} = 'T1' THEN 'left' WHEN {left_right} AND {marker} = 'T2' THEN 'right' "
        f"WHEN {fist_feet} AND {marker} = 'T1' THEN 'fist' WHEN {fist_feet} AND {marker} = 'T2' THEN 'feet' END"
    )


TRIALS = (
    f"cells AS (SELECT vec_id AS trial, label % 2 AS class, c::INTEGER AS channel, s::INTEGER AS sample, "
    f"embedding[c * {SAMPLES} + s + 1]::DOUBLE AS value FROM embeddings, "
    f"(SELECT unnest(range({CHANNELS})) AS c), (SELECT unnest(range({SAMPLES})) AS s))"
)
TOY_SCORES = ", ".join(
    "list_sum(list_transform(range(1, {d} + 1), lambda i: embedding[i]::DOUBLE * {w}[i]))".format(
        d=DIM, w=_listed([toy_weight(c, k) for k in range(DIM)])
    )
    for c in range(TOY_CLASSES)
)
ID_SCORES = ", ".join(
    f"coalesce(list_sum(list_transform(ids, lambda i: (i * {c + 1}) % 7)), 0)" for c in range(3)
)



def _filtered(series: str) -> str:
    """CTEs ending in ``filtered(k, i, value)`` from ``series(k, i, x)``, i = 1 .. n.

    The difference equation as two recursions, one step per sample.
    """
    (b0, b1, b2), (_, a1, a2) = FILTER_B, FILTER_A
    gain = sum(FILTER_B) / sum(FILTER_A)
    y = "({b0}::DOUBLE * {x} + {m})"

    def one_way(name: str, source: str) -> str:
        first = y.format(b0=b0, x="x", m=f"{gain - b0}::DOUBLE * x")
        later = y.format(b0=b0, x="e.x", m="m1")
        return (
            f"{name} AS (SELECT k, pos, {first} AS y, {b2 - a2 * gain}::DOUBLE * x + {b1}::DOUBLE * x - {a1}::DOUBLE * {first} AS m1, "
            f"{b2}::DOUBLE * x - {a2}::DOUBLE * {first} AS m2 FROM {source} WHERE pos = 1 UNION ALL "
            f"SELECT e.k, e.pos, {later}, m2 + {b1}::DOUBLE * e.x - {a1}::DOUBLE * {later}, "
            f"{b2}::DOUBLE * e.x - {a2}::DOUBLE * {later} FROM {name} f JOIN {source} e ON e.k = f.k AND e.pos = f.pos + 1)"
        )

    return (
        f"series AS ({series}), "
        "padded AS (SELECT *, least(9, n - 1) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM series)), "
        "ends AS (SELECT k, max(x) FILTER (i = 1) AS x1, max(x) FILTER (i = n) AS xn FROM padded GROUP BY k), "
        "extended AS (SELECT k, i + p AS pos, x FROM padded "
        "UNION ALL SELECT k, 2 - i + p, 2 * x1 - x FROM padded JOIN ends USING (k) WHERE i BETWEEN 2 AND p + 1 "
        "UNION ALL SELECT k, 2 * n - i + p, 2 * xn - x FROM padded JOIN ends USING (k) WHERE i BETWEEN n - p AND n - 1), "
        f"{one_way('forth', 'extended')}, "
        "turned AS (SELECT k, max(pos) OVER (PARTITION BY k) + 1 - pos AS pos, y AS x FROM forth), "
        f"{one_way('back', 'turned')}, "
        "filtered AS (SELECT s.k, s.i, b.y AS value FROM padded s JOIN back b ON b.k = s.k AND b.pos = s.n + s.p + 1 - s.i)"
    )


ORACLES = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "stream_clean_text": f"SELECT doc_id, {clean(strip_noise('text'))} AS clean_text FROM documents",
    "strip_noise_tokens": (
        "SELECT doc_id, " + strip_noise("('#t ' || text || ' @u - http://x https://y -z')") + " AS stripped FROM documents"
    ),
    "tokens_single_space": (
        "SELECT doc_id, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token "
        "FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)"
    ),
    "class_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "class_shares": (
        "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality"
    ),
    "first_rows": "SELECT * FROM labels ORDER BY doc_id LIMIT 10",
    "duplicate_rows": (
        "SELECT doc_id, length(text) AS n_chars FROM (SELECT doc_id, text, "
        "row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM "
        f"(SELECT doc_id, {strip_noise('text')} AS text FROM documents)) WHERE rn > 1"
    ),
    "label_conflicts": (
        f"WITH {DISAGREEING} SELECT g.first_id, r.doc_id, r.label, g.n FROM rows_ r JOIN groups_ g USING (text)"
    ),
    "label_corrections": (
        f"WITH {DISAGREEING} SELECT r.doc_id, coalesce(g.first_label, r.label) AS label "
        "FROM rows_ r LEFT JOIN groups_ g USING (text)"
    ),
    "vocabulary_rank": (
        f"WITH {WORDS} SELECT word, row_number() OVER (ORDER BY word) AS word_index FROM (SELECT DISTINCT word FROM words)"
    ),
    "word_vector_scan": (
        f"SELECT 'w' || vec_id AS word, unnest(range({DIM}))::INTEGER AS k, unnest(embedding)::DOUBLE AS value FROM embeddings"
    ),
    "sentence_mean_vector": (
        f"WITH {WORDS}, {RANKED}, {VECTORS}, {_mean()} SELECT doc_id, k, round(value, 6) AS value FROM mean"
    ),
    "unknown_words": (
        # Vector i belongs to the word of rank i + 1, so the words past the last vector have none.
        f"WITH {WORDS} SELECT word, count(*) AS n FROM words GROUP BY word "
        "QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) > (SELECT count(*) FROM embeddings)"
    ),
    "word_class_counts": (
        f"WITH {LABELLED} SELECT word, label, count(*) AS n FROM ({_words('labelled', 'doc_id, label')}) GROUP BY ALL"
    ),
    "salient_words": f"WITH {SALIENT} SELECT word, label, n, word_n, round(lift, 6) AS lift FROM salient",
    "salient_weighted_vector": (
        f"WITH {SALIENT}, {WORDS}, {RANKED}, "
        "vectors AS (SELECT r.word, e.embedding AS vector, CASE WHEN r.word IN (SELECT word FROM salient) "
        "THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM ranked r JOIN embeddings e ON e.vec_id = r.place - 1), "
        f"{_mean('v.factor * v.vector[k + 1]::DOUBLE')} SELECT doc_id, k, round(value, 6) AS value FROM mean"
    ),
    "keyword_features": (
        f"WITH {WORDS}, {RANKED}, {VECTORS}, {_mean()} SELECT doc_id, k, round(value, 6) AS value FROM mean "
        f"UNION ALL SELECT doc_id, unnest(range({DIM}, {DIM + len(KEYWORDS)}))::INTEGER AS k, "
        f"unnest(list_transform({_listed(KEYWORDS)}, lambda w: list_contains(t, w)::INTEGER::DOUBLE)) AS value "
        f"FROM (SELECT doc_id, string_split({clean('text')}, ' ') AS t FROM documents)"
    ),
    "encode_fixed_length": (
        f"WITH {ENCODED} SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({ENCODED_LENGTH} - len(ids)), "
        "lambda i: 0)), ' ') AS input_ids, array_to_string(list_concat(list_transform(ids, lambda i: 1), "
        f"list_transform(range({ENCODED_LENGTH} - len(ids)), lambda i: 0)), ' ') AS attention_mask FROM ids"
    ),
    "exact_split_dev": _split("is_dev", 42, "ceil(0.1::DOUBLE * (SELECT count(*) FROM documents))"),
    "exact_split_99": _split("is_train", 7, "floor(0.99::DOUBLE * (SELECT count(*) FROM documents))"),
    "shuffle_positions": (
        "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents"
    ),
    "oversample": (
        f"SELECT doc_id, quality AS label, unnest(range({_weight('quality')} + 1))::INTEGER AS copy FROM labels"
    ),
    "synonym_augment": (
        f"WITH {LABELLED}, {WORDS}, {RANKED}, "
        "synonyms AS (SELECT a.word, b.word AS synonym FROM ranked a JOIN ranked b ON b.place IN (a.place, a.place + 1)), "
        "dictionary AS (SELECT word, list(DISTINCT synonym ORDER BY synonym) AS options FROM synonyms GROUP BY word), "
        f"every AS (SELECT doc_id, text, label, unnest(range({_weight('label')} + 1)) AS copy FROM labelled), "
        "candidates AS (SELECT DISTINCT doc_id, copy, word FROM "
        "(SELECT doc_id, copy, unnest(string_split(text, ' ')) AS word FROM every WHERE copy > 0) "
        f"WHERE NOT list_contains({_listed(STOP_WORDS)}, word)), "
        "drawn AS (SELECT c.doc_id, c.copy, c.word, d.options, md5('42:' || c.doc_id || ':' || c.copy || ':' || c.word) AS key "
        "FROM candidates c JOIN dictionary d USING (word)), "
        "chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, copy ORDER BY key, word) AS turn "
        "FROM drawn) WHERE turn <= 5), "
        "swaps AS (SELECT doc_id, copy, map(list(word), list(options[1 + "
        "(('0x' || substr(key, 1, 8))::BIGINT % len(options))])) AS swap FROM chosen GROUP BY ALL) "
        "SELECT e.doc_id, e.copy::INTEGER AS copy, CASE WHEN s.swap IS NULL THEN e.text ELSE array_to_string(list_transform("
        "string_split(e.text, ' '), lambda w: coalesce(s.swap[w], w)), ' ') END AS text, e.label "
        "FROM every e LEFT JOIN swaps s USING (doc_id, copy)"
    ),
    "argmax_label": (
        "SELECT vec_id, list_position(embedding, list_max(embedding))::INTEGER - 1 AS predicted FROM embeddings"
    ),
    "accuracy": (
        "SELECT round(avg((list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER), 6) AS accuracy, "
        "count(*) AS n FROM embeddings"
    ),
    "cross_entropy": (
        "SELECT round(avg(ln(list_sum(list_transform(embedding, lambda s: exp(s::DOUBLE)))) - embedding[label + 1]::DOUBLE), 6) "
        "AS loss, count(*) AS n FROM embeddings"
    ),
    "epoch_log": (
        f"WITH {EPOCHS} SELECT user_id, epoch, part, n_batches, n_rows, round(loss_per_row, 6) AS loss_per_row, "
        "round(mean_loss, 6) AS mean_loss, round(accuracy, 6) AS accuracy FROM log"
    ),
    "best_checkpoint": (
        f"WITH {EPOCHS} SELECT user_id, model, epoch, dev_loss FROM dev "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dev_loss, epoch) = 1"
    ),
    "running_best": (
        f"WITH {EPOCHS}, seen AS (SELECT *, min(dev_loss) OVER (PARTITION BY user_id ORDER BY epoch "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM dev) "
        "SELECT *, best_before IS NULL OR dev_loss < best_before AS improved FROM seen"
    ),
    "udf_predict": (
        "SELECT vec_id, list_position(s, list_max(s))::INTEGER - 1 AS predicted FROM "
        f"(SELECT vec_id, [{TOY_SCORES}] AS s FROM embeddings)"
    ),
    "encoded_text_label": (
        f"WITH {ENCODED} SELECT doc_id, list_position(s, list_max(s))::INTEGER - 1 AS predicted FROM "
        f"(SELECT doc_id, [{ID_SCORES}] AS s FROM ids)"
    ),
    "submission_align": (
        "SELECT l.doc_id, CASE WHEN d.n_chars > 1000 THEN 1 WHEN d.n_chars <= 1000 THEN 0 END AS target "
        "FROM labels l LEFT JOIN documents d USING (doc_id)"
    ),
    "csv_round_trip": "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents",
    "tsv_round_trip": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "asof_label": (
        "SELECT s.event_id, s.user_id, CASE WHEN a.event_id IS NULL THEN NULL ELSE 'A' || a.event_id END AS code "
        "FROM (SELECT * FROM events WHERE event_type = 'view') s ASOF LEFT JOIN "
        "(SELECT * FROM events WHERE event_type = 'signup') a ON s.user_id = a.user_id AND s.ts >= a.ts"
    ),
    "marker_runs": (
        f"WITH {EVENT_RUNS} SELECT user_id, run_start, marker AS event_type, count(*) AS n FROM marked GROUP BY ALL"
    ),
    "first_n_of_run": (
        f"WITH {EVENT_RUNS} SELECT event_id, user_id, run_start, position - run_start AS sample FROM marked "
        "WHERE run_n >= 3 AND position - run_start < 3"
    ),
    "trial_segments": (
        "WITH timed AS (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events), "
        "sampled AS (SELECT event_id, user_id, value, round(us / 1e6, 5) AS t FROM timed "
        f"WHERE event_type = 'view' AND user_id NOT IN ({', '.join(map(str, EXCLUDED_SUBJECTS))})), "
        "notes AS (SELECT user_id, us / 1e6 AS onset, us / 1e6 + 3600 AS until, CASE event_type WHEN 'click' THEN 'T1' "
        "WHEN 'purchase' THEN 'T2' ELSE 'T0' END AS code FROM timed WHERE event_type <> 'view'), "
        "ends AS (SELECT user_id, max(until) AS until FROM notes GROUP BY user_id), "
        "source AS (SELECT s.event_id, s.user_id, s.value, s.t AS ts, n.code AS marker FROM sampled s "
        "ASOF LEFT JOIN notes n ON s.user_id = n.user_id AND s.t >= n.onset LEFT JOIN ends e ON e.user_id = s.user_id "
        f"WHERE e.until IS NULL OR s.t < e.until), {RUNS}, "
        "cut AS (SELECT user_id AS subject, (3 + user_id % 12)::INTEGER AS run, run_start AS trial, marker, "
        "position - run_start AS sample, value FROM marked WHERE run_n >= 2 AND position - run_start < 2 "
        "AND marker IN ('T1', 'T2')) "
        f"SELECT subject, run, trial, {_task('run', 'marker')} AS task, sample, value FROM cut"
    ),
    "run_task_class": (
        "SELECT * FROM (SELECT event_id, run, marker, " + _task("run", "marker") + " AS task FROM "
        "(SELECT event_id, (3 + user_id % 12)::INTEGER AS run, CASE event_type WHEN 'view' THEN 'T1' WHEN 'click' THEN 'T2' "
        "ELSE 'T0' END AS marker FROM events)) WHERE task IS NOT NULL"
    ),
    "exclude_keys": (
        f"SELECT event_id, user_id FROM events WHERE user_id NOT IN ({', '.join(map(str, EXCLUDED_SUBJECTS))})"
    ),
    "zscore": (
        "SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z "
        "FROM events WINDOW w AS (PARTITION BY event_type)"
    ),
    "channel_center": (
        f"WITH {TRIALS}, own AS (SELECT class, trial, channel, avg(value) AS mean FROM cells GROUP BY ALL), "
        "offsets AS (SELECT class, channel, avg(mean) AS o FROM own GROUP BY ALL) "
        "SELECT c.trial, c.class, c.sample, c.channel, round(c.value - f.o, 6) AS value FROM cells c "
        "JOIN offsets f USING (class, channel)"
    ),
    "class_covariance": (
        f"WITH {TRIALS}, products AS (SELECT a.class, a.channel AS i, b.channel AS j, sum(a.value * b.value) AS total "
        "FROM cells a JOIN cells b USING (class, trial, sample) GROUP BY ALL) "
        "SELECT class, i, j, round(total / sum(CASE WHEN i = j THEN total END) OVER (PARTITION BY class), 6) AS value "
        "FROM products"
    ),
    "log_variance": (
        f"WITH {TRIALS}, energy AS (SELECT trial, channel AS k, sum(value * value) AS e FROM cells GROUP BY ALL) "
        "SELECT trial, k, round(ln(e / sum(e) OVER (PARTITION BY trial)), 6) AS value FROM energy"
    ),
    "iir_filter": (
        f"WITH RECURSIVE {TRIALS}, "
        + _filtered(f"SELECT trial * {CHANNELS} + channel AS k, sample + 1 AS i, value AS x FROM cells")
        + f" SELECT k // {CHANNELS} AS trial, (k % {CHANNELS})::INTEGER AS channel, (i - 1)::INTEGER AS sample, "
        "round(value, 6) AS value FROM filtered"
    ),
    "filter_whole_recordings": (
        "WITH RECURSIVE numbered AS (SELECT event_id, user_id, value, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
        + _filtered("SELECT user_id AS k, i, value AS x FROM numbered")
        + " SELECT n.event_id, n.user_id, round(f.value, 6) AS filtered FROM numbered n "
        "JOIN filtered f ON f.k = n.user_id AND f.i = n.i"
    ),
}
