"""Near vectors against all cosines, with recall and precision; awkward vectors."""

import math
import random

import numpy as np
import pytest

from seasonstar.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def planted(count, groups, size, dim, seed, cosine=0.97):
    """Random vectors, and groups around some of them at about the given cosine to it."""
    rnd = np.random.default_rng(seed)
    rows = list(rnd.standard_normal((count, dim)))
    for g in range(groups):
        centre = rows[g] / np.linalg.norm(rows[g])
        for _ in range(size):
            noise = rnd.standard_normal(dim)
            noise -= (noise @ centre) * centre
            noise /= np.linalg.norm(noise)
            rows.append((cosine * centre + math.sqrt(1 - cosine**2) * noise) * rnd.uniform(0.5, 2))
    return np.array(rows, dtype=np.float32)


def brute(vectors, threshold=0.95):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


def roots(near):
    root = np.arange(len(near))
    while True:
        after = np.array([min([root[i], *root[near[i]]]) for i in range(len(near))])
        if (after == root).all():
            return root
        root = after


def run(spark, vectors):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.vec_id: r for r in embeddings.op9_embeddings(frame).collect()}


def test_links_of_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 50)
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", 30)
    vectors = planted(700, 30, 5, 64, 1) 
    vectors = np.concatenate([vectors, planted(1, 1, 150, 64, 2, 0.985)])
    near = brute(vectors)
    found = run(spark, vectors)
    links = np.array([found[i].n_links for i in range(len(vectors))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.99 * near.sum()
    if (links == near.sum(axis=1)).all():
        root = roots(near)
        assert [found[i].component_id for i in range(len(vectors))] == root.tolist()
        assert all(found[i].kept == (root[i] == i) for i in found)


def test_recall_just_above_the_threshold(spark):
    vectors = planted(1500, 250, 1, 48, 3, 0.951)
    near = brute(vectors)
    links = sum(r.n_links for r in run(spark, vectors).values())
    assert near.sum() > 400 and 0.9 * near.sum() <= links <= near.sum()


def test_awkward_vectors(spark):
    v, nan, inf = [1.0, 2.0, 3.0, 4.0], float("nan"), float("inf")
    rows = [
        (1, v, 0), (1, v, 0), (2, [2 * x for x in v], 1), (3, None, 0), (4, [0.0] * 4, 0),
        (5, [1.0, None, 3.0, 4.0], 0), (6, [nan, 2.0, 3.0, 4.0], 0), (7, [inf, 2.0, 3.0, 4.0], 0),
        (8, [], 0), (9, [-x for x in v], 0), (10, v[:3], 0), (None, v, None), (11, [1e38] * 4, 0),
    ]
    found = embeddings.op9_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by_id[1] == [(3, 1, True)] * 2 and by_id[2] == [(3, 1, False)]
    assert by_id[None] == [(3, 1, None)]
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by_id[alone] == [(0, alone, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert embeddings.op9_embeddings(empty).collect() == []
    assert len(embeddings.op9_embeddings(spark.createDataFrame(rows[3:7], SCHEMA)).collect()) == 4


def test_copies_are_handled_once(spark):
    rnd = random.Random(1)
    v = [rnd.random() for _ in range(16)]
    rows = [(i, v, 0) for i in range(500)]
    found = embeddings.op9_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(499, 0)}


def test_keys_are_shortened_for_vectors_around_a_common_mean(monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TABLES", 32)
    random = np.random.default_rng(6)
    vectors = random.standard_normal((1_000, 32)) + 2.0
    coder = embeddings.learn(vectors, 10_000_000)
    assert coder.key_bits < 24
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    noise = random.standard_normal(unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    partner = 0.95 * unit + math.sqrt(1 - 0.95**2) * noise
    keys = [coder.keys(coder.bits(v)) for v in (unit, partner)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.98
    monkeypatch.setattr(embeddings, "FOUND", 1.1)
    with pytest.raises(ValueError, match="bring together"):
        embeddings.learn(vectors, 10_000_000)


def test_rotation_is_orthogonal_and_codes_are_balanced():
    vectors = planted(800, 0, 0, 32, 5).astype(np.float64) + 0.3
    coder = embeddings.learn(vectors, 800)
    gram = coder.projection[:, :32].T @ coder.projection[:, :32]
    assert np.allclose(gram, np.eye(32), atol=1e-8)
    assert abs(coder.bits(vectors).mean(axis=0) - 0.5).max() < 0.12


def test_tiny_and_huge_doubles(spark):
    vectors = planted(60, 6, 3, 16, 9).astype(np.float64)
    scale = np.array([1e-230, 1.0, 1e230])[np.arange(len(vectors)) % 3][:, None]
    one = embeddings.learn(vectors * scale, 100)
    assert np.isfinite(one.projection).all() and np.isfinite(one.mean).all()
    assert (one.bits(vectors) == one.bits(vectors * scale)).mean() > 0.999
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors * scale)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = brute(vectors)
    assert {r.vec_id: r.n_links for r in embeddings.op9_embeddings(frame).collect()} == {
        i: int(n) for i, n in enumerate(links.sum(axis=1))
    }
