"""Complexity operators against hand-computed values and brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import pytest

from regioscope.operators import complexity as C


def _cells(spark, rows):
    return spark.createDataFrame(rows, "country string, product string, value double")


def test_rca_two_by_two(spark):
    rows = [("r1", "p1", 10.0), ("r1", "p2", 30.0), ("r2", "p1", 30.0), ("r2", "p2", 30.0)]
    r = {(x["region"], x["product"]): (x["rca"], x["m"]) for x in C.rca(_cells(spark, rows)).collect()}
    # total 100; r1: 40, r2: 60; p1: 40, p2: 60
    assert abs(r[("r1", "p1")][0] - (10 / 40) / (40 / 100)) < 1e-12
    assert r[("r1", "p2")][1] == 1 and r[("r1", "p1")][1] == 0
    assert abs(r[("r2", "p1")][0] - (30 / 60) / (40 / 100)) < 1e-12


def _random_m(spark, n_r=12, n_p=15, seed=3):
    rnd = random.Random(seed)
    cells = [(f"r{i}", f"p{j}") for i in range(n_r) for j in range(n_p) if rnd.random() < 0.4]
    return cells, spark.createDataFrame(cells, "region string, product string")


def test_proximity_matches_brute_force(spark):
    cells, m = _random_m(spark)
    got = {(r["a"], r["b"]): r["phi"] for r in C.proximity(m, "product", block_size=4).collect()}
    sets = {}
    for r, p in cells:
        sets.setdefault(p, set()).add(r)
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        co = len(sets[a] & sets[b])
        if co:
            want[(a, b)] = co / max(len(sets[a]), len(sets[b]))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(0 < v <= 1 for v in got.values())


def test_relatedness_brute_force(spark):
    cells, m = _random_m(spark, 6, 7, seed=5)
    phi = C.proximity(m, "product")
    got = {(r["region"], r["product"]): r["density"] for r in C.relatedness(m, phi).collect()}
    P = {(r["a"], r["b"]): r["phi"] for r in phi.collect()}
    prods = sorted({p for _, p in cells})
    def ph(a, b):
        return P.get((min(a, b), max(a, b)), 0.0) if a != b else 0.0
    for (c, p), v in got.items():
        num = sum(ph(q, p) for (cc, q) in cells if cc == c)
        den = sum(ph(q, p) for q in prods)
        assert abs(v - num / den) < 1e-12


def test_fitness_normalised(spark):
    _, m = _random_m(spark)
    f, q = C.fitness(m, iterations=5)
    assert abs(f.agg(F.avg("value")).first()[0] - 1) < 1e-9
    assert abs(q.agg(F.avg("value")).first()[0] - 1) < 1e-9


def test_eci_is_zscore_and_oriented(spark):
    cells, m = _random_m(spark)
    eci, pci = C.complexity_index(m, iterations=10)
    e = {r["name"]: r["value"] for r in eci.collect()}
    v = np.array(list(e.values()))
    assert abs(v.mean()) < 1e-9 and abs(v.std(ddof=1) - 1) < 1e-9
    div = {}
    for r, _ in cells:
        div[r] = div.get(r, 0) + 1
    assert np.corrcoef([e[k] for k in e], [div[k] for k in e])[0, 1] >= 0


def _kruskal_max(nodes, edges):
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    total = 0.0
    for w, a, b in sorted(edges, key=lambda e: -e[0]):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            total += w
    return total


def test_spanning_tree_is_maximum(spark):
    rnd = random.Random(11)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = [(round(rnd.random(), 6), a, b) for a, b in itertools.combinations(nodes, 2)
             if rnd.random() < 0.5]
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a string, b string, phi double")
    tree = C.spanning_tree(df).collect()
    comps = {}
    # n - (number of components) edges, weight equal to Kruskal's
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for w, a, b in edges:
        parent[find(a)] = find(b)
    touched = {n for _, a, b in edges for n in (a, b)}
    n_comp = len({find(n) for n in touched})
    assert len(tree) == len(touched) - n_comp
    assert abs(sum(r["weight"] for r in tree) - _kruskal_max(touched, edges)) < 1e-9


def _brandes(nodes, adj, weighted):
    import heapq
    bc = {v: 0.0 for v in nodes}
    for s in nodes:
        dist, sigma, preds, order = {s: 0.0}, {s: 1.0}, {s: []}, []
        heap, done = [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, l in adj[v]:
                nd = d + (l if weighted else 1.0)
                if w not in dist or nd < dist[w] - 1e-12:
                    dist[w], sigma[w], preds[w] = nd, sigma[v], [v]
                    heapq.heappush(heap, (nd, w))
                elif abs(nd - dist[w]) <= 1e-12 and w not in done:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = {v: 0.0 for v in order}
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    return {v: x / 2 for v, x in bc.items()}


def test_betweenness_path_and_random(spark):
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)],
                                 "a string, b string, weight double")
    got = {r["name"]: r["betweenness"] for r in C.betweenness(path, weighted=False).collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    rnd = random.Random(2)
    nodes = [f"v{i}" for i in range(9)]
    edges = [(a, b, float(rnd.randint(1, 3))) for a, b in itertools.combinations(nodes, 2)
             if rnd.random() < 0.35]
    adj = {n: [] for n in nodes}
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    used = [n for n in nodes if adj[n]]
    want = _brandes(used, adj, True)
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r["name"]: r["betweenness"] for r in C.betweenness(df, weighted=True).collect()}
    assert got.keys() == set(used)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in used)
    parts = {r["name"]: r["betweenness"] for r in C.betweenness(df, max_pairs=30).collect()}
    assert parts.keys() == got.keys() and all(abs(parts[k] - want[k]) < 1e-9 for k in used)


def test_betweenness_long_path_and_odd_edges(spark):
    """More rounds than pieces that are kept apart; parallel edges, loops,
    edges without a weight; no edges at all."""
    n = 15
    path = [(f"p{i:02d}", f"p{i + 1:02d}", 1.0 + i % 3) for i in range(n - 1)]
    odd = [("p00", "p01", 9.0), ("p05", "p05", 1.0), ("p00", "p14", None)]
    df = spark.createDataFrame(path + odd, "a string, b string, weight double")
    got = {r["name"]: r["betweenness"] for r in C.betweenness(df).collect()}
    assert got == {f"p{i:02d}": float(i * (n - 1 - i)) for i in range(n)}
    assert C.betweenness(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        C.betweenness(spark.createDataFrame([("a", "b", 0.0)], df.schema))


def test_degree(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert {r["name"]: r["degree"] for r in C.degree(df).collect()} == {"a": 2, "b": 1, "c": 1}


def test_density_is_zero_without_present_neighbours_and_missing_without_any(spark):
    m = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r"), ("c", "p")], "region string, product string")
    cells = spark.createDataFrame([(r, p) for r in "abc" for p in "pqr"], "region string, product string")
    got = {(r["region"], r["product"]): r["density"] for r in C.relatedness(m, C.proximity(m), cells=cells).collect()}
    assert len(got) == 9 and got["b", "p"] == 0.0 and got["c", "q"] == 1.0
    assert all(got[r, "r"] is None for r in "abc")


def test_proximity_in_blocks_equals_whole(spark):
    import random
    rng = random.Random(1)
    rows = {(f"r{rng.randrange(4)}", f"p{rng.randrange(60)}") for _ in range(220)}
    m = spark.createDataFrame(sorted(rows), "region string, product string")
    whole = {tuple(r) for r in C.proximity(m).collect()}
    assert whole == {tuple(r) for r in C.proximity(m, block_size=7).collect()} and whole


def test_projection_by_threshold_steps(spark):
    """The first step that leaves room, ties of the tree, isolated nodes."""
    w = {("a", "b"): 0.9, ("b", "c"): 0.8, ("a", "c"): 0.75, ("c", "d"): 0.4, ("b", "d"): 0.30, ("a", "d"): 0.25}
    phi = spark.createDataFrame([(a, b, v) for (a, b), v in w.items()], "a string, b string, phi double")
    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "name string")

    def edges(**kw):
        return {(r["a"], r["b"]): r["in_tree"] for r in C.project_network(phi, nodes=nodes, **kw).collect()}
    tree = {("a", "b"): True, ("b", "c"): True, ("c", "d"): True, ("e", None): False, ("z", None): False}
    assert edges(avg_links=1.0, tolerance=0.1) == tree
    assert edges(avg_links=2.0, tolerance=0.1) == tree | {("a", "c"): False}   # 0.30 is not above 0.3
    assert edges(avg_links=2.5, tolerance=0.25) == tree | {("a", "c"): False, ("b", "d"): False}
    assert edges(avg_links=9.0, tolerance=0.1) == tree | {k: False for k in w if k not in tree}
