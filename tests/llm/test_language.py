"""Language identification: held-out accuracy, calibration, and awkward tables."""

import numpy as np
from helpers import AWKWARD, awkward, empty

from seasonstar.llm import language

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    rows = language.op3_language_id(documents).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = documents.withColumn("lang", F.when(language.fold(), "xx").otherwise(F.col("lang")))
    one, two = language.op3_language_id(documents), language.op3_language_id(wrong)
    assert sorted(one.collect()) == sorted(two.collect())


def test_counts_in_blocks_equal_counts_at_once(monkeypatch):
    text = "Grüße aus München, où êtes-vous? " * 50
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "BLOCK_CHARS", 7)
    assert np.array_equal(whole, language.gram_counts(text))
    n = len(text)
    assert whole.sum() == n + (n - 1) + (n - 2)
    assert language.gram_counts("").sum() == 0 and language.gram_counts("a").sum() == 1


def test_temperature_flattens_sure_errors():
    logits = np.array([[9.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    t = language._temperature(logits, labels)
    assert abs(language.softmax(logits[0] / t)[0] - 0.7) < 0.01


def test_awkward_and_empty_tables(spark):
    rows = language.op3_language_id(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    nothing = [r for r in rows if r.doc_id in (2, 3, 4, 7)]
    assert nothing and all((r.lang_pred, r.score) == ("und", 0.0) for r in nothing)
    assert all(r.lang_pred in ("en", "de", "fr") for r in rows if r.doc_id in (5, 6, 8))
    assert language.op3_language_id(empty(spark)).collect() == []
    unlabelled = empty(spark).unionAll(
        spark.createDataFrame([(1, "some text", None, None, None)], empty(spark).schema)
    )
    assert language.op3_language_id(unlabelled).first().lang_pred == "und"
