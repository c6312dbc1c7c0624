"""The near-duplicate join against all shingle sets compared with one another."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, WORD, awkward, empty

from seasonstar.llm import jaccard
from seasonstar.llm.graph import components, roots_of

SF_DIR = "/root/testdata/sf0.001"


def shingle_set(text):
    words = WORD.findall(text or "")
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(texts, threshold=0.8):
    """Links and smallest reachable id by row number."""
    sets = [shingle_set(t) for t in texts]
    owners, links = defaultdict(list), [set() for _ in texts]
    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in owners[s])
        for j, n in common.items():
            if n >= threshold * (len(own) + len(sets[j]) - n):
                links[i].add(j)
                links[j].add(i)
        for s in own:
            owners[s].append(i)
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([root[i], *(root[j] for j in near)])
            changed |= low != root[i]
            root[i] = low
    return links, root


def test_against_brute_force(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in frame.collect())
    links, root = brute([t for _, t in rows])
    found = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.op5_jaccard(frame).collect()}
    assert found == {rows[i][0]: (len(links[i]), rows[root[i]][0]) for i in range(len(rows))}


def test_a_large_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 20)
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(i % 5):
            words[rnd.randrange(150)] = f"x{i}{rnd.random()}"
        texts.append(" ".join(words))
    texts += texts[:60] + [" ".join(rnd.sample(base, 100)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, root = brute(texts)
    found = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.op5_jaccard(frame).collect()}
    assert found == {i: (len(links[i]), root[i]) for i in range(len(texts))}


def test_awkward_and_empty_tables(spark):
    rows = jaccard.jaccard_links(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.class_id, r.n_links, r.n_copies))
    assert by_id[1] == {(1, 1, 2), (1, 0, 1)}
    for alone in (2, 3, 4, 5, 6, 7, 8):
        assert by_id[alone] == {(alone, 0, 1)}
    assert jaccard.op5_jaccard(empty(spark)).collect() == []


def test_one_row_of_each_class_stays(spark):
    frame = awkward(spark)
    kept = jaccard.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts == Counter({(r[0], r[1]): 2 if r[1] is None else 1 for r in AWKWARD})


def test_near_copies_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, end]) for end in ("one", "two", "three")]
    rows = [(None, near[0]), (None, near[1]), (None, near[1]), (7, near[2]), (7, "of another kind, quite")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.op5_jaccard(frame).collect())
    assert found == Counter({(None, 7, 3): 3, (7, 7, 3): 1, (7, 7, 0): 1})
    assert jaccard.drop_near_duplicates(frame).count() == 2


def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch):
    text = " ".join(f"wörd{i % 97}" for i in range(3000)) + " " + "y" * 3000 + " end"
    whole = jaccard.word_hashes(text)
    assert len(whole) == len(WORD.findall(text)) and len(set(whole.tolist())) == 99
    monkeypatch.setattr(jaccard, "BYTES_AT_A_TIME", 100)
    assert np.array_equal(whole, jaccard.word_hashes(text))


def test_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 1 << 63, 3000).astype(np.uint64)
    one, two = jaccard.signature(values[:2500]), jaccard.signature(values[500:])
    assert abs((one == two).mean() - 2000 / 3000) < 0.1


@pytest.mark.parametrize(("threshold", "tolerance"), [(0.8, 1e-6), (0.5, 1e-3)])
def test_looks_follow_the_posterior(threshold, tolerance):
    for n, least in jaccard.fewest_matches(threshold, tolerance):
        grid = np.linspace(0, 1, 20001)[1:-1]

        def reaches(m, n=n, grid=grid):
            weight = np.exp(m * np.log(grid) + (n - m) * np.log1p(-grid))
            return weight[grid >= threshold].sum() / weight.sum()

        assert reaches(least) >= tolerance * 0.98
        assert least == 0 or reaches(least - 1) < tolerance * 1.02


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)]
    pairs += [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 900)] + [(5, 5)]
    root = roots_of(1000, np.array(pairs))
    found = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {
        i: int(root[i]) for i in range(1000) if root[i] != i
    }
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_words_across_pieces_hash_like_whole_ones():
    size = jaccard.BYTES_AT_A_TIME
    mask = (1 << 64) - 1

    def whole(word):
        total = len(word)
        for i, byte in enumerate(word):
            total += int(jaccard._BYTE[byte]) * pow(jaccard._BASE, i, 1 << 64)
        return int(jaccard._mixed(np.array([total & mask], dtype=np.uint64))[0])

    words = ["a", "x" * (size - 2), "é" * 5, "yz" * size, "b", "c" * (size - 1), "last" * 40]
    for text in (" ".join(words), "\n".join(words) + " ", " " * (size - 1) + " ".join(words[::-1])):
        assert jaccard.word_hashes(text).tolist() == [whole(w.encode()) for w in text.split()]


def test_a_very_long_word_leaves_no_larger_tables():
    before = jaccard._POWERS.nbytes + jaccard._INVERSE.nbytes
    assert len(jaccard.word_hashes("x" * 20_000_000)) == 1
    assert jaccard._POWERS.nbytes + jaccard._INVERSE.nbytes == before
