"""Small awkward tables shared by the tests of the training-text operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: NULLs in every column, empty and very long texts, repeated rows, one doc_id with two texts.
AWKWARD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "another text of the same doc", "en", "a", 28),
    (2, None, "en", "a", None),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "no id at all", "en", None, 12),
    (4, " \t\n ", "de", "b", 4),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "x" * 200_000, "fr", "c", 200_000),
    (7, "1 2 3 !!! ???", "fr", "c", 13),
    (8, "déjà vu   　naïve <|endoftext|> tail", "fr", None, 34),
]


def awkward(spark):
    """The awkward rows with further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    extra = "key shard slot size block run row_hash taken spans score lang_pred n_words count".split()
    frame = spark.createDataFrame(AWKWARD, DOCS)
    return frame.select("*", *[F.lit("extra").alias(name) for name in extra])


def empty(spark):
    return spark.createDataFrame([], DOCS)
