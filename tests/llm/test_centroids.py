"""Exact centroid clustering against plain Python integers."""

import hashlib
import math
import random
from array import array

from regioscope.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, id string, v string, cluster string, distance string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "v", "c", "d", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == j] for j in range(len(cs))]
        cs = [[sum(col) // len(vs) for col in zip(*vs)] if vs else c for vs, c in zip(own, cs)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), cs


def test_clusters(spark):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(f"{x + rng.gauss(0, .3):.3f}") for x in middle[i % 5]]) for i in range(150)]
    rows += [(200 + i, list(rows[7][1])) for i in range(30)] + [(7, list(rows[7][1]))]  # copies, one of a repeated id
    rows = [(i, array("f", v).tolist()) for i, v in rows]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [float("nan")] * 64),
           (305, [float("inf")] * 64), (306, [0.0] * 64), (307, [-0.001] * 64)]
    want, cs = brute(rows + odd)
    got, centers = centroids.cluster(frame(spark, rows + odd))
    assert sorted(map(tuple, got.collect())) == want and centers == cs
    out = centroids.digests(frame(spark, rows + odd)).collect()
    total = sum(d for _, _, d in want)
    for r in out:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cs[r["cluster"]])).encode()).hexdigest()


def test_few_rows_ties_and_large_components(spark):
    assert centroids.digests(frame(spark, [])).collect() == []
    one = [(5, [0.5] * 64), (None, [0.5] * 64)]
    got = sorted(map(tuple, centroids.digests(frame(spark, one)).collect()), key=str)
    assert [r[:5] for r in got] == [(5, 0, 0, 0, 0), (None, 0, 0, 0, 0)]  # a tie: the smaller number
    far = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1e30] * 64)]
    got = centroids.digests(frame(spark, far)).collect()
    assert [r["distance"] for r in got] == [0, 0, 0]
