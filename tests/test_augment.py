import hashlib

import pytest

from conftest import rows
from quillwave.operators.augment import default_stop_words, synonym_augment
from quillwave.operators.skew import JoinLimits

SYNONYMS = {"good": ["fine", "good", "nice_one"], "film": ["movie"], "bad": ["poor", "good"], "the": ["a"]}
TEXTS = [
    (0, "the good film is  a good film", 0),
    (1, "bad good the film", 2),
    (2, "nothing to replace", 0),
    (3, "bad film", 1),
    (4, " ".join(["good", "film", "bad"] + [f"x{i}" for i in range(9)]), 0),
]
WEIGHTS = [3, 0, 1]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def expected(n_words, stops, extra):
    table = {**SYNONYMS, **extra}
    out = []
    for i, text, label in TEXTS:
        out.append((i, 0, text, label))
        for copy in range(1, WEIGHTS[label] + 1):
            tokens = text.split(" ")
            words = [w for w in dict.fromkeys(tokens) if w not in stops and w in table]
            words.sort(key=lambda w: md5(f"42:{i}:{copy}:{w}"))
            swap = {}
            for w in words[:n_words]:
                options = sorted(set(table[w]))
                swap[w] = options[int(md5(f"42:{i}:{copy}:{w}")[:8], 16) % len(options)]
            out.append((i, copy, " ".join(swap.get(w, w) for w in tokens), label))
    return sorted(out)


@pytest.mark.parametrize("limits", [JoinLimits(), JoinLimits(broadcast_rows=0)])
def test_augment_matches_brute_force(spark, limits):
    extra = {f"x{i}": [f"y{i}", f"z{i}"] for i in range(9)}
    pairs = [(w, s) for w, options in {**SYNONYMS, **extra}.items() for s in options]
    df = spark.createDataFrame(TEXTS, "id int, text string, label int")
    synonyms = spark.createDataFrame(pairs + pairs[:2], "word string, synonym string")
    got = synonym_augment(df, "id", "text", "label", WEIGHTS, synonyms, stop_words=["the"], limits=limits)
    assert sorted(tuple(r) for r in got.select("id", "copy", "text", "label").collect()) == expected(5, {"the"}, extra)


def test_default_stop_words(spark):
    assert {"the", "is"} <= set(default_stop_words())
    df = spark.createDataFrame([(0, "the film", 0)], "id int, text string, label int")
    synonyms = spark.createDataFrame([("the", "a"), ("film", "movie")], "word string, synonym string")
    got = synonym_augment(df, "id", "text", "label", [1], synonyms)
    assert rows(got, "copy", "text") == [(0, "the film"), (1, "the movie")]
