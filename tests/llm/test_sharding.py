"""Sharding: a permutation, even shards, gapless slots, the same again on another layout."""

import zlib

import pytest
from helpers import AWKWARD, awkward, empty
from pyspark.sql import functions as F

from seasonstar.llm import sharding

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("count", [1, 2, 3, 6, 7, 12, 50, 1009])
def test_every_number_is_hit_once(spark, count):
    for seed in (1, 2):
        place = sharding.permuted(spark, F.col("id"), count, seed)
        found = [r.p for r in spark.range(count).select(place.alias("p")).collect()]
        assert sorted(found) == list(range(count))
        if count > 40:
            assert sum(a == b for a, b in enumerate(found)) < count / 5


def test_digest_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = sharding.op1_sharding(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows")
        assert r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_layout_does_not_matter(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = ["doc_id", "shard", "slot"]
    one = sharding.op1_sharding(documents).select(columns)
    two = sharding.op1_sharding(documents.repartition(7, "text")).select(columns)
    assert one.exceptAll(two).isEmpty()


def test_awkward_and_empty_tables(spark):
    rows = sharding.op1_sharding(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    places = {(r.shard, r.slot) for r in rows}
    assert len(places) == len(AWKWARD) and all(s < 2 for _, s in places)
    assert {r["size"] for r in rows if r.doc_id == 2} == {1}
    assert sharding.op1_sharding(empty(spark)).collect() == []


def test_rows_of_one_key_are_spread(spark):
    rows = spark.range(20_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")
    )
    numbered = sharding.number_rows(rows, "doc_id", ["text"], buckets=64)
    assert sorted(r.row_number for r in numbered.select("row_number").collect()) == list(range(20_000))
    # neighbours in number are a bucket, so its rows are those of one hash
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(64)).alias("bucket")
    sizes = [r["count"] for r in numbered.groupBy(bucket).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * sorted(sizes)[32]
    runs = numbered.groupBy(bucket).agg((F.max("row_number") - F.min("row_number") + 1 - F.count("*")).alias("gap"))
    assert runs.where("gap != 0").isEmpty()
