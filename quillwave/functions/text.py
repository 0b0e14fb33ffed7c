"""Column expressions on text. All of them are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The characters Python's str.split() treats as whitespace.
# Java's \s covers only the ASCII ones.
WHITESPACE_CHARS = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def _spaced(text: Column, dropped: str) -> Column:
    """Every whitespace a plain space, and without the ``dropped`` characters."""
    return F.translate(text, WHITESPACE_CHARS + dropped, " " * len(WHITESPACE_CHARS))


def clean_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, words joined by one space."""
    return F.trim(F.regexp_replace(_spaced(F.lower(text), PUNCTUATION), " {2,}", " "))


def clean_words(text: Column) -> Column:
    """Words of the cleaned text, with empty items where spaces are doubled.

    Cheaper than splitting :func:`clean_text` where empty items are dropped
    later anyway.
    """
    return F.split(_spaced(F.lower(text), PUNCTUATION), " ", -1)


def split_words(text: Column) -> Column:
    """Split on any whitespace, without empty items."""
    return F.filter(F.split(_spaced(text, ""), " ", -1), lambda word: word != "")


def split_clean(clean: Column) -> Column:
    """Split text that is already the result of :func:`clean_text`."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def split_single_space(text: Column) -> Column:
    """Split on every single space; empty items stay."""
    return F.split(text, " ", -1)


def strip_noise_tokens(text: Column) -> Column:
    """Drop hash tags, user names, ``http://`` links and lone dashes."""

    def wanted(word: Column) -> Column:
        return (
            ~F.startswith(word, F.lit("#"))
            & ~F.startswith(word, F.lit("@"))
            & ~F.contains(word, F.lit("http://"))
            & (word != "-")
        )

    return F.array_join(F.filter(split_words(text), wanted), " ")


def replace_tokens(tokens: Column, replacements: Column) -> Column:
    """Swap whole tokens through a word -> word map column, all at once."""
    return F.transform(
        tokens,
        lambda word: F.coalesce(F.try_element_at(replacements, word), word),
    )


def repeatable_key(seed: str | int, *parts: Column) -> Column:
    """Hex key that orders rows at random but always the same way."""
    pieces: list[Column] = [F.lit(str(seed))]
    for part in parts:
        pieces += [F.lit(":"), part.cast("string")]
    return F.md5(F.concat(*pieces))


def text_digest(text: Column) -> Column:
    """32-byte stand-in for a long text in shuffles that compare texts."""
    return F.unhex(F.sha2(text, 256))


def zero_padded(number: Column, width: int) -> Column:
    """Number as text with leading zeros."""
    return F.format_string(f"%0{width}d", number)


def run_stamp(moment: Column | None = None) -> Column:
    """``yyyy-MM-dd_HH-mm-ss`` of a timestamp, now by default."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyy-MM-dd_HH-mm-ss")
