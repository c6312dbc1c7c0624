"""BPE against the tokenizers library, and exact round trips."""

import hashlib

import pytest
from helpers import AWKWARD, awkward, empty
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seasonstar.llm import bpe

SF_DIR = "/root/testdata/sf0.001"
CASES = [
    "", "a", "<|endoftext|>", "x <|endoftext|> y  ", "<|endoftext|><|endoftext|>", "!<|endoftext|>!",
    "  \n\n  a  b　 c\x1c\x85d", "it's we'LL 'll  ²½ 12 34\t\tx", " lead", "trail  ",
    "ünïcödé 日本語 👩‍👩‍👧 é", "<|endoftext|", "a﻿b​ c", None, "   \n" * 5 + "z", "a" * 5000,
    " " * 3000, "\x00 \x01", "�", "\r\n\r\n",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.public_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digest_against_the_library(spark, library):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = bpe.op6_bpe(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(decoded))


def test_crafted_texts_and_their_way_back(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_BYTES", 2000)
    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    tokens = bpe.encode(frame, vocabulary)
    for r in bpe.decode(tokens, vocabulary).collect():
        expected = library.encode(CASES[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == expected and r.n_tokens == len(expected)
        assert r.text == library.decode(expected, skip_special_tokens=False) == (CASES[r.doc_id] or "")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=50, max_size=80))
def test_any_text(spark, vocabulary, library, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(frame, vocabulary).collect():
        again = bpe.decode_ids(list(r.ids), vocabulary.pieces)
        assert again == texts[r.doc_id]
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_awkward_and_empty_tables(spark, vocabulary):
    rows = bpe.op6_bpe(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.n_tokens == 0 and r.ids_sha256 == sha("") for r in rows if r.doc_id in (2, 3))
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 2
    assert bpe.op6_bpe(empty(spark)).collect() == []


def test_texts_are_shuffled_once(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    done = bpe.op6_bpe(documents)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 1
