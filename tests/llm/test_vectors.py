"""Near-duplicate vectors against brute force."""

import brute
import numpy as np
import pytest

from regioscope.llm import pivot_permutation

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, key string"


def vectors(seed, n, dim, groups, size):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for g in range(groups):
        rows += [rows[g] + rng.normal(size=dim) * 0.2 * rng.random() for _ in range(size)]
    rows += [rows[0]] * 5 + [rows[1] * 3.0]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [768, 8])
def test_links_and_components(spark, block, monkeypatch):
    monkeypatch.setattr(pivot_permutation, "BLOCK", block)
    rows = vectors(1, 200, 32, 4, 30)
    last = len(rows)
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0],
           [1e-30] * 32, [1e30] * 32, [-1.0, -2.0], [5.0]]
    rows += [(last + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, "r", "n", "k") for r in rows], SCHEMA).repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in pivot_permutation.near_duplicates(df).collect()}
    want = brute.near_vectors(rows)
    found, links = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert len(got) == len(want) and links > 1000
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * links
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    for i in range(last, last + 6):
        assert got[i] == (0, i, True)
    assert got[last + 6][1] == got[last + 7][1] == last + 6 and got[last + 8][1] == got[last + 9][1] == last + 8


def close_pairs(rng, n, dim, low, high):
    """Random unit vectors and partners at a cosine from ``low`` to ``high``."""
    v, w = rng.normal(size=(2, n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    c = rng.uniform(low, high, size=(n, 1))
    return v, c * v + np.sqrt(1 - c * c) * w


@pytest.mark.parametrize("pivots", [6, 42])
def test_recall_of_the_index(spark, pivots, monkeypatch):
    """Pairs just above the threshold, the hardest ones; with 87 pivots as
    this table has, and with 600 as a table of a million vectors has."""
    monkeypatch.setattr(pivot_permutation, "PIVOTS", pivots)
    v, w = close_pairs(np.random.default_rng(2), 1500, 64, 0.951, 0.97)
    rows = [(i, x.tolist()) for i, x in enumerate(np.stack([v, w], axis=1).reshape(-1, 64))]
    df = spark.createDataFrame([(*r, 1, "r", "n", "k") for r in rows], SCHEMA)
    found = pivot_permutation.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.9 * len(rows)


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("n", [32, 128, 300, 600, 1300, 4096])
def test_recall_of_prefixes_at_every_number_of_pivots(dim, n):
    rng = np.random.default_rng(n + dim)
    pivots = rng.normal(size=(n, dim))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    v, w = close_pairs(rng, 1000, dim, 0.951, 0.96)
    a, b = pivot_permutation.prefixes(v, pivots), pivot_permutation.prefixes(w, pivots)
    shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    assert (shared >= pivot_permutation.SHARED).mean() >= 0.95


def test_no_vectors_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pivot_permutation.near_duplicates(none).collect() == []
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "r", "n", "k") for r in rows], SCHEMA)
    got = sorted(map(tuple, pivot_permutation.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 0, None, True), (5, 0, 5, True)], key=str)
