"""Union outlines against a cell-by-cell definition."""

import random

import pytest

from regioscope.functions import geo as G
from regioscope.operators import dissolve as DS

SCHEMA = "g string, rings " + G.RINGS_TYPE.simpleString()


def square(i, j, w=1.0, flip=False):
    p = [(i, j), (i + w, j), (i + w, j + w), (i, j + w), (i, j)]
    return [{"x": float(x), "y": float(y)} for x, y in (p[::-1] if flip else p)]


def parity(rings, x, y):
    inside = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]):
                inside = not inside
    return inside


def rings(spark, cells):
    df = spark.createDataFrame([(g, [square(i, j, flip=(i + j) % 2 == 1)]) for g, i, j in cells], SCHEMA).repartition(3)
    out = {}
    for r in DS.dissolve_rings(df, ["g"]).collect():
        out.setdefault(r["g"], []).append(r)
    return out


def test_hole_touching_corners_and_parts(spark):
    ring8 = [("hole", i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    got = rings(spark, ring8 + [("touch", 0, 0), ("touch", 1, 1), ("apart", 0, 0), ("apart", 5, 5), ("row", 0, 0), ("row", 1, 0)])
    assert sorted((r["is_hole"], r["area"], r["n_vertices"]) for r in got["hole"]) == [(False, 9.0, 12), (True, 1.0, 4)]
    assert [(r["is_hole"], r["area"]) for r in got["touch"]] == [(False, 1.0)] * 2
    assert [(r["is_hole"], r["area"]) for r in got["apart"]] == [(False, 1.0)] * 2
    (row,) = got["row"]
    assert [(p["x"], p["y"]) for p in row["ring"]] == [(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1), (0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_cells(spark, seed):
    rng = random.Random(seed)
    cells = [(g, i, j) for g in "abc" for i in range(9) for j in range(9) if rng.random() < 0.6]
    got = rings(spark, cells)
    for g in "abc":
        own = {(i, j) for h, i, j in cells if h == g}
        assert sum(-r["area"] if r["is_hole"] else r["area"] for r in got[g]) == len(own)
        lines = [r["ring"] for r in got[g]]
        for i in range(9):
            for j in range(9):
                assert parity(lines, i + 0.51, j + 0.47) == ((i, j) in own)


def test_holes_of_the_input_repeated_and_missing_polygons(spark):
    holed = [square(0, 0, 4.0), square(1, 1)]
    df = spark.createDataFrame([("a", holed), ("a", holed), ("a", None), ("b", []), ("c", [square(0, 0, 4.0)]),
                                ("c", [square(9, 9)])], SCHEMA)
    got = sorted((r["g"], r["is_hole"], r["area"]) for r in DS.dissolve_rings(df, ["g"]).collect())
    assert got == [("a", False, 16.0), ("a", True, 1.0), ("c", False, 1.0), ("c", False, 16.0)]
    filled = spark.createDataFrame([("a", holed), ("a", [square(1, 1)])], SCHEMA)
    assert [(r["is_hole"], r["area"]) for r in DS.dissolve_rings(filled, ["g"]).collect()] == [(False, 16.0)]
    nameless = spark.createDataFrame([(None, [square(0, 0)]), (None, [square(0, 1)])], SCHEMA)
    assert [(r["g"], r["area"], r["n_vertices"]) for r in DS.dissolve_rings(nameless, ["g"]).collect()] == [(None, 2.0, 6)]
    assert DS.dissolve_rings(df.limit(0), ["g"]).collect() == []
