"""The pipeline: order of stages, columns in between, decisions, and another brute-force way."""

from collections import Counter

from helpers import DOCS, awkward, empty
from tokenizers import Tokenizer

import corpus_pipeline
from seasonstar.llm import bpe, language, mixing, secret_scan
from test_jaccard import brute

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "stage")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == NAMES and docs.schema == documents.schema

    before, after = seen["language ID"]
    found = language.identify(before, language.train(before)).collect()
    assert {r.doc_id for r in after.collect()} == {
        r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5
    }

    before, after = seen["n-gram Jaccard join"]
    rows = sorted(before.collect())
    _, root = brute([r.text for r in rows])
    assert sorted(after.collect()) == [r for i, r in enumerate(rows) if root[i] == i]

    before, after = seen["secret scans"]
    assert before.count() == after.count()
    ratios = secret_scan.train(secret_scan.labelled_samples(before))
    left = {r.doc_id: r for r in after.collect()}
    for r in secret_scan.scan(before, ratios).collect():
        assert all(r.text[s.start : s.end] not in left[r.doc_id].text for s in r.spans if s.kind)
        assert left[r.doc_id].n_chars == len(left[r.doc_id].text)
        assert r.spans or left[r.doc_id].text == r.text

    before, after = seen["mixing sources to target weights"]
    times = {r.doc_id: round(r.taken / r["size"] + 1e-9) for r in mixing.mix(before).collect() if r["size"]}
    found = Counter(r.doc_id for r in after.collect())
    assert all(abs(found[d] - n) <= 1 and found[d] <= 3 for d, n in times.items())

    before, after = seen["BPE encoding and decoding"]
    library = Tokenizer.from_file(bpe.public_path())
    expected = Counter((r.doc_id, *library.encode(r.text, add_special_tokens=False).ids) for r in before.collect())
    assert Counter((r.doc_id, *r.ids) for r in after.collect()) == expected


def test_awkward_and_empty_documents(spark, tmp_path):
    for name, frame in (("awkward", awkward(spark)), ("empty", empty(spark))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert name == "awkward" or rows == []
        assert {r.doc_id for r in rows} <= {1, 5, 6, 8, None}


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(entry.oracle_sql()) <= names
    assert DOCS.startswith("doc_id")


def test_the_last_stage_decodes_what_it_encodes(spark):
    rows = [(1, "déjà vu, load_table(7)\n\n  tail"), (1, "another text"), (2, ""), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.tokens(spark, frame, "").collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(bool(r.ids) == bool(r.text) for r in found)
