"""Line-first cleaning against a brute-force count, and its rules one by one."""

from collections import Counter

import pytest
from helpers import AWKWARD, WORD, awkward, empty
from pyspark.sql import functions as F

from seasonstar.llm import cleaning

SF_DIR = "/root/testdata/sf0.001"
GOOD = "The quick brown fox jumps over the lazy dog near the river bank today."


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(repeated),
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in cleaning.op2_cleaning(documents).collect():
        expected = base(texts[r.doc_id])
        assert tuple(r[c] for c in COLUMNS) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)


def test_awkward_and_empty_tables(spark):
    rows = cleaning.clean_lines(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    expected = Counter((r[0], *base(r[1])) for r in AWKWARD)
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows) == expected
    assert all(r.base_failed and r.clean_text is None for r in rows if r.text is None)
    assert cleaning.op2_cleaning(empty(spark)).collect() == []


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        (GOOD, False),
        ("A sentence.", False),
        ("Ein „Satz“ mit Umlauten und ß, der endet.", False),
        ("no stop at the end but a good many words in it", False),
        ("two words", True),
        ("*** --- ***", True),
        ("wo$$$ rd%%% s*** li&&& ke### th*** is$$$", True),
        ("Home | About | Contact", True),
        ("Read more", True),
        ("Copyright 2021 Example", True),
        ("Licensed under CC BY-NC 4.0.", True),
        ("© Example. All rights reserved.", True),
        ("|" * 50_000, True),
    ],
)
def test_line_rules(spark, line, fails):
    text = "\n".join([GOOD, line, "", GOOD + " Again."])
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = cleaning.clean_lines(frame, min_words=1).first()
    assert row.n_failed_lines == int(fails)
    assert (line not in row.clean_text.split("\n")) == fails


def test_documents_that_lose_too_much_go(spark):
    def words(prefix, count, tail):
        return " ".join(f"{prefix}{i}" for i in range(count)) + tail

    rows = [
        (1, "\n".join(words(f"w{k}x", 20, ".") for k in range(5))),
        (2, "\n".join([words("a", 30, "."), words("b", 80, "$$$$").replace(" ", "%%%% ")])),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in cleaning.clean_lines(frame).collect()}
    assert kept == {1: True, 2: False}


def test_the_plan_has_no_shuffle_and_no_python(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = cleaning.op2_cleaning(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert cleaning.op2_cleaning(documents).filter(F.col("kept")).count() > 0
