"""Composite index invariants."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from regioscope.operators import composite as P


def _matrix(spark, n=20, seed=4):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    rows = [(f"u{i}", float(a[i]), float(a[i] * 2 + rng.normal() * 0.1), float(rng.normal()),
             float(rng.normal() * 5 + 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, x1 double, x2 double, x3 double, x4 double")


def test_p2_weights_and_scale_invariance(spark):
    df = _matrix(spark)
    cols = ["x1", "x2", "x3", "x4"]
    idx, w = P.p2_index(df, "id", cols)
    ws = w.collect()
    assert all(0 <= r["weight"] <= 1 for r in ws)
    last = max(r["iteration"] for r in ws)
    first = [r for r in ws if r["iteration"] == last and r["position"] == 1]
    assert first[0]["weight"] == 1.0
    scaled = df.withColumn("x4", F.col("x4") * 1000)
    idx2, _ = P.p2_index(scaled, "id", cols)
    a = {r["id"]: r["index"] for r in idx.collect()}
    b = {r["id"]: r["index"] for r in idx2.collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_discrimination_brute_force(spark):
    df = _matrix(spark, n=15)
    got = {r["indicator"]: r["discrimination"] for r in P.discrimination(df, ["x4", "x1"]).collect()}
    vals = [r["x4"] for r in df.collect()]
    m = len(vals)
    pair = sum(abs(a - b) for a, b in itertools.combinations(vals, 2))
    want = 2 / (m * (m - 1)) * pair / abs(np.mean(vals))
    assert abs(got["x4"] - want) < 1e-9


def test_value_positions_exact(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), F.round(F.rand(5) * 40).alias("x"))
    rows = P.value_positions(df, "g", "x", partitions=7).collect()
    data = df.collect()
    for g in range(3):
        xs = sorted(r["x"] for r in data if r["g"] == g)
        got = {r["x"]: (r["n"], r["before"]) for r in rows if r["g"] == g}
        assert got == {x: (xs.count(x), xs.index(x)) for x in set(xs)}


def test_strata_of_missing_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,), (float("nan"),)], "x double")
    rows = P.cum_root_f(df, "x", strata=5, bins=10).collect()
    assert len(rows) == 22
    assert all((r["stratum"] is None) == (r["x"] is None or r["x"] != r["x"]) for r in rows)
    alone = spark.createDataFrame([(3.0,), (None,)], "x double")
    assert {r["x"]: r["stratum"] for r in P.cum_root_f(alone, "x", 5, 10).collect()} == {3.0: 1, None: None}


def test_p2_matches_a_plain_derivation(spark):
    """Order, weights and index from numpy on the collected matrix."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    idx, w = P.p2_index(df, "id", ["a", "b", "c", "d"])
    dist = np.abs(x - x.min(axis=0))
    sd, corr = dist.std(axis=0, ddof=1), np.corrcoef(dist.T)
    weights, order, seen = np.ones(4), [0, 1, 2, 3], set()
    for it in range(21):
        index = dist @ (weights / sd)
        r = [np.corrcoef(dist[:, j], index)[0, 1] for j in range(4)]
        new = sorted(range(4), key=lambda j: (-abs(r[j]), j))
        if it and (new == order or tuple(new) in seen):
            break
        seen.add(tuple(new))
        order, weights = new, np.ones(4)
        for k in range(1, 4):
            j, prev = order[k], order[:k]
            weights[j] = 1 - corr[prev, j] @ np.linalg.pinv(corr[np.ix_(prev, prev)]) @ corr[prev, j]
    got = {r["id"]: r["index"] for r in idx.collect()}
    assert all(abs(got[i] - index[i]) < 1e-8 for i in range(40))


def test_cum_root_f(spark):
    const = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert {r["stratum"] for r in P.cum_root_f(const, "x", strata=5, bins="by_rows").collect()} == {1}
    df = spark.range(0, 500).select((F.col("id") ** 2).cast("double").alias("x"))
    s = P.cum_root_f(df, "x", strata=5, bins=20).collect()
    strata = {r["stratum"] for r in s}
    assert strata <= {1, 2, 3, 4, 5} and len(strata) >= 3
    # monotone in x
    pairs = sorted((r["x"], r["stratum"]) for r in s)
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))
    lab = spark.createDataFrame([(5,), (1,)], "s int").select(P.stratum_labels("s")).collect()
    assert [r[0] for r in lab] == ["Very High", "Very Low"]


def test_p2_says_how_it_ended(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    _, w = P.p2_index(df, "id", list("abcd"))
    assert {r["ended"] for r in w.collect()} <= {"fixed point", "cycle"}
    _, w = P.p2_index(df, "id", list("abcd"), max_iter=0)
    assert {r["ended"] for r in w.collect()} == {"limit"}
