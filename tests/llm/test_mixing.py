"""Mixing: targets by repeated sharing, seats by listed quotients, taken words near targets."""

import random
from collections import defaultdict

import pytest
from helpers import AWKWARD, WORD, awkward, empty
from pyspark.sql import functions as F

from seasonstar.llm import mixing

SF_DIR = "/root/testdata/sf0.001"


def shared(sizes, weights, most=3.0):
    """The excess over the caps shared again until no source is above its cap."""
    capped, total = {}, float(sum(sizes))
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(capped.values())
        weight = sum(weights[i] for i in rest)
        aims = {i: left * weights[i] / weight for i in rest} if rest else {}
        above = {i: most * sizes[i] for i in rest if aims[i] > most * sizes[i]}
        if not above:
            return [capped.get(i, aims.get(i)) for i in range(len(sizes))]
        capped |= above


def highest_quotients(sizes, seats):
    out = [0] * len(sizes)
    for _ in range(seats):
        open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
        best = max(open_, key=lambda i: (sizes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 5, 40, 40, 1000, 3]) for _ in range(rnd.randrange(1, 40))] + [7]
    seats = rnd.choice([0, 1, 2, 5, 30, 500])
    parties = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "name int, size long")
    found = mixing.apportion(parties, "name", "size", F.lit(seats), []).collect()
    assert [r.seats for r in sorted(found)] == highest_quotients(sizes, seats)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000], [0, 5, 3, 900, 2, 2, 1], [0, 0]])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "source string, size long")
    weights = [i % 3 + 1 for i in range(len(sizes))]
    weight = (F.substring("source", 2, 9).cast("int") % 3 + 1).cast("double")
    found = sorted(mixing.targets(frame, "size", weight).collect())
    assert [r.target for r in found] == pytest.approx(shared(sizes, weights))


def test_taken_words_come_near_the_targets(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = mixing.mix(documents).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    for source, aim in target.items():
        assert abs(taken[source] - aim) <= 4 * mixing.BLOCK_WORDS
    again = mixing.mix(documents.repartition(5, "text")).collect()
    assert sorted(rows) == sorted(again)


def test_awkward_and_empty_tables(spark):
    rows = mixing.op8_mixing(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["size"] == r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    assert names == ["a", "b", "c", None]
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in names]
    targets = {r.source: r.target for r in rows}
    assert [targets[s] for s in names] == pytest.approx(shared(sizes, [1, 2, 3, 1]))
    assert mixing.op8_mixing(empty(spark)).collect() == []


def test_repeated_documents_keep_their_columns(spark):
    frame = awkward(spark)
    mixed = mixing.repeat_to_mix(frame)
    assert mixed.columns == frame.columns
    assert mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    assert mixing.repeat_to_mix(empty(spark)).collect() == []
