"""The corpus pipeline: raw documents to token ids, a written table after every stage.

Each stage takes (spark, docs, sf_dir), with docs the table of the stage before it, and all but
the last return the columns of ``documents``, whatever other names these have. An empty table
goes through all stages as one. A NULL text has no language and goes in the first; so does a text
without a letter. Repeated rows and equal texts stay one in the second, the one with the smallest
doc_id. The operators' docstrings say how each of them breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonstar.llm import bpe, jaccard, language, mixing, secret_scan
from seasonstar.llm.common import table, written

#: Calibrated probability below which a document's language counts as unknown.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without one, or unsure, go."""
    found = language.identify(docs, language.train(docs), ("__lang", "__score"))
    sure = (F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return jaccard.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret cut out of the text."""
    return secret_scan.redact(docs).withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.repeat_to_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them."""
    vocabulary = bpe.Vocabulary(bpe.public_path())
    return bpe.encode(docs, vocabulary, text_too=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: The stages learn models and hash texts, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
