"""Geometry predicates and spatial joins."""

import math

from pyspark.sql import functions as F

from regioscope.functions import geo as G
from regioscope.operators import spatial as SP

SQUARE = [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0},
           {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]
HOLE = [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 2.0, "y": 2.0},
        {"x": 1.0, "y": 2.0}, {"x": 1.0, "y": 1.0}]


def _polys(spark):
    return spark.createDataFrame(
        [(1, "plain", SQUARE), (2, "holed", [r for r in SQUARE] + [HOLE]),
         (3, "empty", [[{"x": 10.0, "y": 10.0}, {"x": 11.0, "y": 10.0}, {"x": 10.5, "y": 11.0},
                        {"x": 10.0, "y": 10.0}]])],
        G.RINGS_TYPE.simpleString().join(["poly_id int, name string, rings ", ""]))


def test_point_in_polygon_with_hole(spark):
    p = _polys(spark).where("poly_id = 2")
    pts = [(0.5, 0.5, True), (1.5, 1.5, False), (3.9, 3.9, True), (5.0, 1.0, False)]
    for x, y, want in pts:
        got = p.select(G.point_in_polygon("rings", F.lit(x), F.lit(y))).first()[0]
        assert got == want, (x, y)


def test_convex_half_plane_agreement(spark):
    import random
    rnd = random.Random(1)
    pts = [(rnd.uniform(-1, 5), rnd.uniform(-1, 5)) for _ in range(300)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    poly = _polys(spark).where("poly_id = 1").select("rings").first()[0]
    got = df.select("lon", "lat", G.point_in_polygon(F.lit(poly).cast(G.RINGS_TYPE) if False else
                    F.array(*[F.array(*[F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y"))
                                         for p in ring]) for ring in poly]),
                    F.col("lon"), F.col("lat")).alias("inside")).collect()
    for r in got:
        want = 0 < r["lon"] < 4 and 0 < r["lat"] < 4
        if min(abs(r["lon"]), abs(r["lon"] - 4), abs(r["lat"]), abs(r["lat"] - 4)) > 1e-9:
            assert r["inside"] == want


def test_spatial_join_preserves_sides(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, None, 1.0), (4, 20.0, 20.0)],
                                "pid int, lon double, lat double")
    polys = _polys(spark)
    left = SP.spatial_join(pts, polys, cell=1.0)
    m = sorted((r["pid"], r["poly_id"]) for r in left.collect())
    assert m == [(1, 1), (1, 2), (2, 1), (3, None), (4, None)]
    right = SP.spatial_join(pts, polys, cell=1.0, preserve="polygons")
    per = {}
    for r in right.collect():
        per.setdefault(r["poly_id"], []).append(r["pid"])
    assert per[3] == [None] and sorted(per[1]) == [1, 2]


def test_polygons_within_disc(spark):
    lon0, lat0 = -99.0, 19.0
    d = 0.03  # ~3.3 km in latitude
    ring = [[{"x": lon0 - 0.01, "y": lat0 + d}, {"x": lon0 + 0.01, "y": lat0 + d},
             {"x": lon0 + 0.01, "y": lat0 + d + 0.01}, {"x": lon0 - 0.01, "y": lat0 + d + 0.01},
             {"x": lon0 - 0.01, "y": lat0 + d}]]
    df = spark.createDataFrame([(1, ring)], "poly_id int, rings " + G.RINGS_TYPE.simpleString())
    assert SP.polygons_within(df, lon0, lat0, 3000).count() == 0
    assert SP.polygons_within(df, lon0, lat0, 3500).count() == 1
    hv = df.select(G.haversine_m(F.lit(lon0), F.lit(lat0), F.lit(lon0), F.lit(lat0 + d))).first()[0]
    assert abs(hv - d * math.pi / 180 * G.EARTH_RADIUS_M) < 1e-6


def test_edge_index_agrees_with_the_whole_rings(spark):
    """Random stars with a hole, cells from far smaller to far larger than
    the polygons; edges of a large polygon are not copied to every cell."""
    import random
    rnd = random.Random(4)
    rows = []
    for k in range(6):
        cx, cy, n = rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.choice([3, 7, 40])
        at = [(math.tau * i / n, rnd.uniform(0.5, 3.0)) for i in range(n)]
        ring = [{"x": cx + r * math.cos(a), "y": cy + r * math.sin(a)} for a, r in at]
        hole = [{"x": cx + 0.2 * math.cos(a), "y": cy + 0.2 * math.sin(a)} for a in (0, 2, 4)]
        rows.append((k, [ring + ring[:1], hole + hole[:1]]))
    polys = spark.createDataFrame(rows, "poly_id int, rings " + G.RINGS_TYPE.simpleString())
    pts = spark.createDataFrame([(i, rnd.uniform(-7, 7), rnd.uniform(-7, 7)) for i in range(1500)],
                                "pid int, lon double, lat double").cache()
    both = pts.crossJoin(polys)
    want = {(r["pid"], r["poly_id"]) for r in both.where(G.point_in_polygon("rings", "lon", "lat")).collect()}
    assert len(want) > 200
    for cell in (0.07, 0.9, 50.0):
        got = SP.spatial_join(pts, polys, cell=cell, preserve="inner").select("pid", "poly_id").collect()
        assert sorted(map(tuple, got)) == sorted(want), cell
    cells = SP.polygon_cells(polys, 0.07)
    assert "rings" not in cells.columns
    per_cell = cells.selectExpr("avg(size(_edges))", "max(size(_edges))").first()
    assert per_cell[0] < 1 and per_cell[1] < 40
    # a shuffle join with a hot cell split over salts gives the same
    got = SP.spatial_join(pts, polys, cell=0.9, preserve="inner", max_broadcast_rows=0, hot_cell_rows=3)
    assert sorted((r["pid"], r["poly_id"]) for r in got.collect()) == sorted(want)


def test_utm_against_a_published_point(spark):
    """A point whose UTM coordinates are published; the scale on the central
    meridian; a missing coordinate."""
    df = spark.range(1)
    r = df.select(*G.utm_xy(F.lit(-74.0060), F.lit(40.7128), 18)).first()
    assert abs(r[0] - 583959.4) < 1.0 and abs(r[1] - 4507351.0) < 1.0
    a, b = (df.limit(1).select(*G.utm_xy(F.lit(-99.0), F.lit(lat), 14)).first() for lat in (19.0, 19.001))
    assert abs(a[0] - 500000) < 1e-6 and abs((b[1] - a[1]) / (0.9996 * 110.6921) - 1) < 1e-5  # metres of 0.001 degrees
    assert df.limit(1).select(*G.utm_xy(F.lit(None).cast("double"), F.lit(1.0), 14)).first()[0] is None
