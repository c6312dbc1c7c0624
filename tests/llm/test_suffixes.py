"""Repeated passages against a table of all strings seen so far; sorting against ``sorted``."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from seasonstar.llm import suffixes

SF_DIR = "/root/testdata/sf0.001"
LETTERS = st.binary(max_size=60).map(lambda b: bytes(97 + x % 2 for x in b))


def brute(documents):
    """Documents in order of doc_id; those with one doc_id do not count as earlier than another."""
    seen, out = {}, []
    for doc_id, text in sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, dtype=bool)
        for i in range(len(data) - 99):
            place = seen.setdefault(data[i : i + 100], (doc_id, i))
            if place != (doc_id, i) and (place[0] != doc_id or place[1] < i):
                gone[i + 1 : i + 101] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(data, gone[1:], strict=False) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize(
    "block_bytes, many_forms", [(8 << 20, 1 << 16), (1 << 16, 1 << 16), (1 << 17, 2)]
)
def test_against_brute_force(spark, block_bytes, many_forms):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    documents = [(r.doc_id, r.text) for r in frame.collect()]
    found = suffixes.remove_repeats(
        frame, digest=True, block_bytes=block_bytes, many_forms=many_forms
    ).collect()
    assert sorted(map(tuple, found)) == sorted(brute(documents))


@pytest.mark.parametrize("size", [40, 99, 103])
def test_a_line_with_other_neighbours_each_time_is_in_no_large_part(spark, size):
    rnd = random.Random(size)

    def noise(length):
        return "".join(rnd.choices("abcdefgh ", k=length))

    line, tail = noise(size), noise(30)
    texts = [noise(rnd.randint(0, 150)) + line + noise(rnd.randint(0, 150)) for _ in range(300)]
    texts += [noise(80) + line + tail for _ in range(5)] + [texts[7][20:], texts[8] + texts[9]]
    documents = list(enumerate(texts))
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    found = suffixes.remove_repeats(frame, digest=True, block_bytes=1 << 14, many_forms=50)
    assert sorted(map(tuple, found.collect())) == sorted(brute(documents))


def test_strings_of_an_anchor_with_many_forms_are_asked_once_a_block(spark):
    rnd = random.Random(9)

    def noise(length):
        return "".join(rnd.choices("abcdefgh ", k=length))

    line = noise(103)
    texts = [noise(90) + line + noise(110) for _ in range(200)]
    blocks = [(i % 4, i, t) for i, t in enumerate(texts)]
    placed = suffixes._packed(spark.createDataFrame(blocks, "block long, doc_id long, text string"))
    none = spark.createDataFrame([], suffixes._TOLD)
    told = suffixes._tell_hashes(suffixes._ask_hashes(placed, none, 4), 1, 20)
    alone = suffixes._tell_hashes(suffixes._ask_strings(placed, told, 4), 3, 20)

    def rows(told):
        asked = suffixes._ask_surroundings(placed, told, 4).collect()
        return [r for a in asked for r in suffixes._table(a.blob).to_pylist()]

    sent = rows(told.unionAll(alone))
    surroundings = Counter(r["after"][:32] for r in sent if not r["alone"])
    assert max(surroundings.values(), default=0) <= 20
    # 4 blocks; the 4 strings of the line are in each, others share a few bytes of noise besides
    strings = Counter(r["after"].decode() for r in sent if r["alone"])
    assert max(strings.values()) == 4
    assert all(strings[line[i : i + 100]] == 4 for i in range(4))


def test_periodic_and_crafted_texts(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("ab") for _ in range(300))
    texts = [
        "", "a" * 1000, "a" * 99, "a" * 100, base, base[50:200] + "x" + base[100:], "zz" + base,
        base[:100], "é" * 200, "b" * 70_000 + base + "a" * 70_000, ("abc" * 50 + base) * 3, None,
        base + base, base[:250] + "y", "y" + base[1:], base[30:131],
    ]
    documents = [(3 * i % 16, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    for many_forms in (1 << 16, 0):
        found = suffixes.remove_repeats(
            frame, digest=True, block_bytes=500, many_forms=many_forms
        ).collect()
        assert sorted(map(tuple, found)) == sorted(brute(documents))


def test_awkward_and_empty_tables(spark):
    frame = awkward(spark)
    documents = [(r.doc_id, r.text) for r in frame.collect()]
    found = [tuple(r) for r in suffixes.op7_suffix_dedup(frame).collect()]
    assert sorted(found, key=key) == sorted(brute(documents), key=key)
    assert suffixes.op7_suffix_dedup(empty(spark)).collect() == []


def test_another_text_with_the_id_of_a_copy_stays(spark):
    rnd = random.Random(5)
    one, two = ("".join(rnd.choices("abcdef ", k=300)) for _ in range(2))
    documents = [(1, one), (5, one), (5, two), (6, two[:150] + "x")]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    found = suffixes.remove_repeats(frame, digest=True).collect()
    assert sorted(map(tuple, found)) == sorted(brute(documents))


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, max_size=40), st.sampled_from([0, 8, 32]))
def test_deep_shallow_order_is_sorted_order(strings, shallow):
    order = suffixes.deep_shallow_order(strings, shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=30), st.binary(max_size=30))
def test_common_prefix(shared, one, two):
    size = suffixes.common_prefix(shared + one, shared + two)
    assert (shared + one)[:size] == (shared + two)[:size] and size >= len(shared)
    assert (shared + one)[size : size + 1] != (shared + two)[size : size + 1] or size >= min(
        len(shared + one), len(shared + two)
    )


def test_equal_strings_share_an_anchor_at_the_same_place():
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abc ") for _ in range(200_000))
    passage = bytes(rnd.choice(b"abc ") for _ in range(100))
    one, two = b"x" * 313 + passage + text, text[:70_001] + passage + text[70_001:]
    index, place, _, _ = suffixes.anchors([one, two, passage])
    inside = [
        set(place[(index == i) & (place >= at) & (place <= at + 68)] - at)
        for i, at in ((0, 313), (1, 70_001), (2, 0))
    ]
    assert inside[2] and inside[2] <= inside[0] and inside[2] <= inside[1]
