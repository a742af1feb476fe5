"""Small frames shared by the tests of this folder."""

from __future__ import annotations

import re
import string

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox again.", "en", "a", 70),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \t\n\x0b \r", "de", "a", 6),
    (5, "é\x85ñ  日本 \U0001F600\x1c<|endoftext|>x <|im_end|>", "fr", "b", 30),
    (6, "word " * 3000, "en", "a", 15000),
    (7, "x" * 5000, "en", "b", 5000),
    (8, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox again.", "en", "b", 70),
    (8, "The quick brown fox jumps over the lazy dog.\nThe quick brown fox again.", "en", "b", 70),
    (9, "one two", "en", "a", 7),
    (10, "one", "en", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that operators make themselves.
CLASHES = ["ids", "key", "fp", "component_id", "length", "start", "kept", "removed", "row", "word", "n", "spans", "score"]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("other") for c in CLASHES})


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
