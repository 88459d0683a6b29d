"""Batched regressions against Spark ML's single fits; exact AUROC."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from regioscope.operators import elastic as EL
from regioscope.operators import ranking as RK


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 6)) * [1, 5, 0.2, 1, 1, 1] + [0, 100, 0, 0, 0, 0]
    x[:, 4] = rng.integers(0, 2, 600)
    x[:, 5] = 3.0  # constant
    y = (x[:, 0] - 0.3 * (x[:, 1] - 100) + x[:, 4] + rng.logistic(size=600) > 0.4).astype(float)
    part = np.where(np.arange(600) < 250, 0, rng.integers(0, 4, 600))  # a hot part
    return spark.createDataFrame([(int(p), float(t), Vectors.dense(v)) for p, t, v in zip(part, y, x)],
                                 ["part", "y", "features"]).repartition(3).cache()


POINTS = [(0.0, 0.0), (0.05, 0.5), (0.02, 1.0), (0.1, 0.0), (5.0, 1.0)]


@pytest.mark.parametrize("own", [True, False])
def test_equals_single_fits(rows, own, monkeypatch):
    d = EL.design(rows, "part")
    points = [(p, a, m) for p in d.parts for a, m in POINTS]
    for chunk in (64 << 20, 2000):  # bounded passes first, in several chunks
        monkeypatch.setattr(EL, "CHUNK_BYTES", chunk)
        fits = EL.fit_many(d, points, own, tol=1e-7)
        assert EL.gradient_condition(fits).max() <= 1e-7
        intercepts, coefs = fits.raw()
        for i, (p, a, m) in list(enumerate(points))[::3]:
            train = rows.where((F.col("part") == int(p)) == F.lit(own))
            one = LogisticRegression(labelCol="y", regParam=a, elasticNetParam=m, tol=1e-10, maxIter=500).fit(train)
            assert np.allclose(coefs[:, i], one.coefficients.toArray(), atol=2e-4), (p, a, m)
            assert abs(intercepts[i] - one.intercept) < 2e-2
            assert np.count_nonzero(coefs[:, i]) <= np.count_nonzero(np.abs(one.coefficients.toArray()) > 1e-9)


def test_a_wrong_fit_violates_the_condition(rows):
    d = EL.design(rows, "part")
    fits = EL.fit_many(d, EL.grid_points(d.parts, [0.05], [0.5]), own=False)
    fits.w[1, 0] += 0.01
    bad = EL.gradient_condition(fits)
    assert bad[0] > 1e-4 and (bad[1:] <= 1e-5).all()


def test_f1_and_auroc_of_a_grid(rows):
    d = EL.design(rows, "part")
    _, asked, every, f1 = EL.cross_validate(d, [0.0, 0.05, 9.0], [0.5, 1.0], "f1")
    assert len(asked) == 4 * 6 and len(set(every)) == 4 * 5  # one fit without a penalty
    _, _, _, area = EL.cross_validate(d, [0.0, 0.05, 9.0], [0.5, 1.0])
    for i in (0, 3, 9):
        p, a, m = asked[i]
        one = LogisticRegression(labelCol="y", regParam=a, elasticNetParam=m).fit(rows.where(F.col("part") != int(p)))
        out = one.transform(rows.where(F.col("part") == int(p)))
        assert abs(MulticlassClassificationEvaluator(labelCol="y", metricName="f1").evaluate(out) - f1[i]) < 5e-3
        s = np.array([(r["probability"][1], r["y"]) for r in out.collect()])
        pos, neg = s[s[:, 1] == 1, 0], s[s[:, 1] == 0, 0]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert abs(want - area[i]) < 2e-3
    assert all(abs(v - 0.5) < 1e-12 for (p, a, m), v in zip(asked, area) if a == 9.0)  # all scores tie
    points = EL.mean_over_folds(asked, f1)
    assert [(a, m) for a, m, _ in points] == [(a, m) for a in (0.0, 0.05, 9.0) for m in (0.5, 1.0)]


def test_separated_group_ends(spark):
    rows = spark.createDataFrame([("a", float(i > 9), Vectors.dense([float(i > 9), float(i % 3)])) for i in range(20)],
                                 ["g", "y", "features"])
    d = EL.design(rows, "g")
    fits = EL.fit_many(d, [("a", 0.0, 0.0)], own=True)
    assert EL.gradient_condition(fits).max() <= 1e-5 and np.isfinite(fits.w).all()
    assert EL.design(rows.limit(0), "g").parts == []


def test_auroc_is_exact(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(rng.integers(0, 9)), int(rng.random() < 0.4)) for g in "ab" for _ in range(300)]
    data += [("one", 1.0, 1), ("one", 2.0, 1), ("a", None, 1), ("a", 3.0, None)]
    got = {r["g"]: r for r in RK.auroc(spark.createDataFrame(data, "g string, score double, y int"), "g").collect()}
    for g in "ab":
        pos = np.array([s for h, s, t in data if h == g and t == 1 and s is not None])
        neg = np.array([s for h, s, t in data if h == g and t == 0 and s is not None])
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert abs(got[g]["auroc"] - want) < 1e-12 and got[g]["n"] == 300 and got[g]["positives"] == len(pos)
    assert got["one"]["auroc"] is None


@pytest.mark.parametrize("n", [3, EL.FEW_FITS + 2])
def test_sums_of_a_pass(rows, n):
    d = EL.design(rows, "part")
    fits = EL._start(d, [("0", a, 1.0) for a in np.linspace(0, 1, n)], own=False)
    w = fits.w + np.random.default_rng(1).normal(size=fits.w.shape)
    w[0, 0] = 2000.0  # margins beyond the range of exp
    at = np.arange(n)
    blocks = [(np.frombuffer(r["y"]), np.frombuffer(r["z"]).reshape(r["n"], -1))
              for r in d.blocks.where("part != '0'").collect()]
    y, z = (np.concatenate(x) for x in zip(*blocks))
    margin = z @ w
    prob = 0.5 * (1 + np.tanh(margin / 2))
    loss = (np.logaddexp(0, margin) - y[:, None] * margin).sum(0)
    for hessians in (True, False):
        got = {(r["fit"], r["row"]): np.array(r["v"]) for r in EL._pass(fits, at, w, hessians).collect()}
        assert len(got) == n * (1 + hessians * len(w))
        for i in range(n):
            assert np.allclose(got[i, -1][:-1], z.T @ (prob[:, i] - y))
            # a bounded step looks at no loss, so none is summed
            assert np.isclose(got[i, -1][-1], loss[i] if hessians else 0)
            if hessians:
                h = z.T @ (z * (prob[:, i] * (1 - prob[:, i]))[:, None])
                assert np.allclose([got[i, j][:-1] for j in range(len(w))], h)
