"""Awkward rows that every operator must take."""

from __future__ import annotations

LONG = "word" * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, score double"


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash with inner ones."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "\x00\n \t", "en", "a", 4), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13), (4, "other text of this id", "en", "b", 21),
        (None, "a text without an id, long enough to have some n-grams", "en", "b", 5), (None, None, None, None, None), (7, LONG, "en", "a", len(LONG)), (8, "x " * 30_000, "de", "a", 60_000), (9, "ÄÖÜ été 中文 😀 🇨🇭", "fr", "c", 10),
    ]
    return spark.createDataFrame([(*r, "k", 1, 0.5) for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
