import random
import string

from pyspark.sql import functions as F

from conftest import rows
from quillwave.functions import text as tx


# text, cleaned, without noise tokens
SPECIAL = [
    ('', '', ''),
    ('   ', '', ''),
    ('...', '', '...'),
    ("e-f's", 'efs', "e-f's"),
    ('\xc9t\xe9  \xd1and\xfa', '\xe9t\xe9 \xf1and\xfa', '\xc9t\xe9 \xd1and\xfa'),
    ('a\xa0b\x85c', 'a b c', 'a b c'),
    ('None', 'none', 'None'),
    ('NA', 'na', 'NA'),
    ('#tag @user - -x http://a https://b xhttp://y end', 'tag user x httpa httpsb xhttpy end', '-x https://b end'),
    ('\tlead and trail\n', 'lead and trail', 'lead and trail'),
    ('\u2014dash \u2013 stays', '\u2014dash \u2013 stays', '\u2014dash \u2013 stays'),
    ('a\u2003b\u3000c\u202fd', 'a b c d', 'a b c d'),
    ('\x1ca\x1fb', 'a b', 'a b'),
    ('-', '', ''),
    ('#', '', ''),
    ('mixed\r\nlines', 'mixed lines', 'mixed lines'),
]


def both(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = df.select("id", tx.clean_text(F.col("text")), tx.strip_noise_tokens(F.col("text"))).orderBy("id")
    return [(r[1], r[2]) for r in out.collect()]


def test_special_texts(spark):
    assert both(spark, [t for t, _, _ in SPECIAL]) == [(a, b) for _, a, b in SPECIAL]


def test_properties_of_random_texts(spark):
    draw = random.Random(3)
    alphabet = string.ascii_letters + string.punctuation + " \t\n \u0085\u00e9\u00df\u00f1\u2014#@-"
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(500)]
    for text, (cleaned, stripped) in zip(texts, both(spark, texts)):
        assert not set(cleaned) & set(string.punctuation), repr(text)
        assert cleaned == cleaned.lower() and "  " not in cleaned
        # Letters stay, in their order.
        assert [c for c in cleaned if c.isalpha()] == [c for c in text.lower() if c.isalpha()]
        left = iter(text.split())
        assert all(any(word == other for other in left) for word in stripped.split()), repr(text)
        assert not any(word.startswith(("#", "@")) for word in stripped.split())


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in SPECIAL], "text string")
    once = df.select(tx.clean_text(F.col("text")).alias("a")).select("a", tx.clean_text(F.col("a")).alias("b"))
    assert all(r.a == r.b for r in once.collect())


def test_splits(spark):
    df = spark.createDataFrame([("a  b ",), ("",)], "t string").select(
        tx.split_single_space(F.col("t")), tx.split_words(F.col("t")), tx.split_clean(tx.clean_text(F.col("t")))
    )
    assert [tuple(r) for r in df.collect()] == [
        (["a", "", "b", ""], ["a", "b"], ["a", "b"]),
        ([""], [], []),
    ]


def test_replace_key_stamp(spark):
    df = spark.createDataFrame([("a b a c",)], "t string").select(
        F.array_join(
            tx.replace_tokens(tx.split_single_space(F.col("t")), F.create_map(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("z"))),
            " ",
        ).alias("swapped"),
        tx.run_stamp(F.timestamp_seconds(F.lit(0))).alias("stamp"),
        tx.zero_padded(F.lit(3), 3).alias("padded"),
        F.length(tx.text_digest(F.col("t"))).alias("width"),
    )
    # All at once: the new "b" is not replaced again.
    assert rows(df) == [("b z b c", "1970-01-01_00-00-00", "003", 32)]
