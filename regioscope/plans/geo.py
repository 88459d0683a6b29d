"""Product C, spatial side: businesses in neighbourhood polygons, the
campus catchment series, its weighted index and quadratic trend."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from regioscope.functions import geo as G
from regioscope.operators import aggregates as A
from regioscope.operators import dissolve as DS
from regioscope.operators import joins as J
from regioscope.operators import spatial as SP
from regioscope.operators import trend as T
from regioscope.operators import windows as W
from regioscope.functions.rsem import r_in
from regioscope.plans.bindings import (GRID_DX, GRID_DY, GRID_X0, GRID_Y0, SHEAR, load,
                                       polygons, r6, score)
from regioscope.plans.registry import R6, query

# The catchment centre (lon, lat) and radius in metres.
CAMPUS_LON, CAMPUS_LAT, RADIUS_M = -99.1409753, 19.2840616, 5000.0
# Binding values: snapshot months of the yearly maps.
SNAPSHOTS = ["1995-10-01", "1996-11-01", "1997-11-01", "1998-11-01", "1999-11-01",
             "2000-11-01"]


def _lit(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def business_points(spark, sf_dir):
    """Businesses (customers) as points with their mean line score; the
    line table is pre-aggregated by order, then by customer."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", score(F.col("l_discount")).alias("q"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("q").alias("_sq"), F.count("q").alias("_cq"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_cust = (o.join(per_order, o.o_orderkey == per_order.l_orderkey)
                .groupBy("o_custkey").agg(F.sum("_sq").alias("_sq"), F.sum("_cq").alias("_cq")))
    c = load(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    pts = c.select("c_custkey",
                   (F.lit(-99.36) + ((k * 37) % 1000) * 0.0004).alias("lon"),
                   (F.lit(19.10) + ((k * 91) % 1000) * 0.00045).alias("lat"))
    return (pts.join(per_cust, pts.c_custkey == per_cust.o_custkey, "left")
            .select("c_custkey", "lon", "lat", F.try_divide("_sq", "_cq").alias("q")))


POINTS_SQL = f"""
pts AS (SELECT c_custkey,
               {_lit(-99.36)} + ((c_custkey * 37) % 1000) * {_lit(0.0004)} AS lon,
               {_lit(19.10)} + ((c_custkey * 91) % 1000) * {_lit(0.00045)} AS lat, q
        FROM customer LEFT JOIN (SELECT o_custkey, sum(abs(l_discount) * 10.0) / count(*) AS q
                                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                                 GROUP BY 1) s ON c_custkey = o_custkey)
"""


def _corner_sql(di: int, dj: int) -> str:
    y = f"({_lit(GRID_Y0)} + (floor(n_nationkey / 5) + {dj}) * {_lit(GRID_DY)})"
    x = (f"({_lit(GRID_X0)} + (n_nationkey % 5 + {di}) * {_lit(GRID_DX)} + "
         f"({y} - {_lit(GRID_Y0)}) * {_lit(SHEAR)})")
    return f"{{'x': {x}, 'y': {y}}}"


POLYS_SQL = f"""
polys AS (SELECT n_nationkey AS poly_id, n_name, n_regionkey,
                 [{_corner_sql(0, 0)}, {_corner_sql(1, 0)}, {_corner_sql(1, 1)},
                  {_corner_sql(0, 1)}, {_corner_sql(0, 0)}] AS ring
          FROM nation)
"""


def pip_sql(ring: str, px: str, py: str) -> str:
    """SQL twin of ``geo.point_in_polygon`` for a single closed ring."""
    a, b = f"{ring}[i]", f"{ring}[i + 1]"
    cross = (f"CASE WHEN (({a}.y > {py}) <> ({b}.y > {py})) AND "
             f"({px} < {a}.x + ({b}.x - {a}.x) * (({py} - {a}.y) / ({b}.y - {a}.y))) "
             f"THEN 1 ELSE 0 END")
    return f"(list_sum(list_transform(range(1, len({ring})), lambda i: {cross})) % 2 = 1)"


def dist_sql(ring: str, lon0: float, lat0: float) -> str:
    """SQL twin of ``geo.min_ring_distance_m`` for a single ring."""
    k = G.EARTH_RADIUS_M * math.pi / 180.0
    kx = k * math.cos(math.radians(lat0))
    a, b = f"{ring}[i]", f"{ring}[i + 1]"
    ax, ay = f"(({a}.x - {_lit(lon0)}) * {_lit(kx)})", f"(({a}.y - {_lit(lat0)}) * {_lit(k)})"
    bx, by = f"(({b}.x - {_lit(lon0)}) * {_lit(kx)})", f"(({b}.y - {_lit(lat0)}) * {_lit(k)})"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"greatest(0.0, least(1.0, coalesce(-({ax} * {dx} + {ay} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0.0)))"
    qx, qy = f"({ax} + {t} * {dx})", f"({ay} + {t} * {dy})"
    return f"list_min(list_transform(range(1, len({ring})), lambda i: sqrt({qx} * {qx} + {qy} * {qy})))"


# -- points in polygons (J7), polygons with points (J8) -----------------------

@query("j7_points_in_polygons", sql="WITH " + POINTS_SQL + "," + POLYS_SQL + f"""
, j AS (SELECT p.q, g.poly_id, g.n_name FROM pts p LEFT JOIN polys g
          ON {pip_sql('g.ring', 'p.lon', 'p.lat')})
SELECT poly_id, n_name, {R6('avg(q)')} AS eqi, CAST(count(*) AS BIGINT) AS n
FROM j GROUP BY poly_id, n_name
""")
def j7_points_in_polygons(spark, sf_dir):
    """Every business joined to the neighbourhood containing it (kept when
    outside all), then mean score (NA skipped) and row count per
    neighbourhood; businesses outside form their own NULL group."""
    j = SP.spatial_join(business_points(spark, sf_dir), polygons(spark, sf_dir),
                        preserve="points")
    g = A.group_stats(j, ["poly_id", "n_name"], "q", mean="eqi", sd=None, na_rm=True)
    return g.select("poly_id", "n_name", r6("eqi").alias("eqi"), F.col("n").cast("long"))


@query("j8_polygons_with_points", sql="WITH " + POINTS_SQL + "," + POLYS_SQL + f"""
, j AS (SELECT g.poly_id, g.n_name, p.q FROM polys g LEFT JOIN pts p
          ON {pip_sql('g.ring', 'p.lon', 'p.lat')}),
s AS (SELECT poly_id, n_name,
             CASE WHEN count(q) = count(*) THEN avg(q) END AS qi,
             CASE WHEN count(q) = count(*) THEN stddev_samp(q) END AS sd, count(*) AS n0
      FROM j GROUP BY 1, 2)
SELECT poly_id, n_name, {R6('100 * coalesce(qi, 0)')} AS quality_index, {R6('sd')} AS std_dev,
       CAST(CASE WHEN qi IS NULL THEN 0 ELSE n0 END AS BIGINT) AS n,
       {R6('CASE WHEN qi IS NULL THEN 0 ELSE n0 END * coalesce(qi, 0)')} AS cohort_potential
FROM s
""")
def j8_polygons_with_points(spark, sf_dir):
    """Every neighbourhood with its businesses (an empty one keeps one row
    of NAs), mean / sd / count, empty-group repair, cohort potential, and
    the quality index in percent."""
    j = SP.spatial_join(business_points(spark, sf_dir), polygons(spark, sf_dir),
                        preserve="polygons")
    g = A.group_stats(j, ["poly_id", "n_name"], "q")
    g = A.cohort_potential(g, percent=True)
    return g.select("poly_id", "n_name", r6("quality_index").alias("quality_index"),
                    r6("std_dev").alias("std_dev"), F.col("n").cast("long").alias("n"),
                    r6("cohort_potential").alias("cohort_potential"))


# -- disc intersection (J9), dissolve (A13) -------------------------------------

DISC_SQL = (f"({pip_sql('ring', _lit(CAMPUS_LON), _lit(CAMPUS_LAT))} OR "
            f"{dist_sql('ring', CAMPUS_LON, CAMPUS_LAT)} <= {RADIUS_M})")


@query("j9_disc_polygons", sql="WITH " + POLYS_SQL + f"""
SELECT poly_id, n_name, n_regionkey FROM polys WHERE {DISC_SQL}
""")
def j9_disc_polygons(spark, sf_dir):
    """Neighbourhoods meeting the 5 km disc around the campus point."""
    p = SP.polygons_within(polygons(spark, sf_dir), CAMPUS_LON, CAMPUS_LAT, RADIUS_M)
    return p.select("poly_id", "n_name", "n_regionkey")


@query("a13_dissolve", sql="WITH " + POLYS_SQL + f"""
SELECT n_regionkey, {R6('min(list_min(list_transform(ring, lambda p: p.x)))')} AS minx,
       {R6('min(list_min(list_transform(ring, lambda p: p.y)))')} AS miny,
       {R6('max(list_max(list_transform(ring, lambda p: p.x)))')} AS maxx,
       {R6('max(list_max(list_transform(ring, lambda p: p.y)))')} AS maxy,
       CAST(count(*) AS BIGINT) AS n
FROM polys GROUP BY n_regionkey
""")
def a13_dissolve(spark, sf_dir):
    """Neighbourhoods dissolved per region: extent and polygon count."""
    d = A.dissolve(polygons(spark, sf_dir), ["n_regionkey"])
    return d.select("n_regionkey", *[r6(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")],
                    F.col("n").cast("long"))


@query("a13_dissolve_rings", sql="WITH RECURSIVE " + POLYS_SQL + f"""
, c AS (SELECT n_regionkey, list_transform(ring, lambda p: [CAST(round(p.x * 1e9) AS BIGINT), CAST(round(p.y * 1e9) AS BIGINT)]) AS r
        FROM polys),
d AS (SELECT n_regionkey, r[i] AS a, r[i + 1] AS b FROM c, range(1, 5) t(i)),
u AS (SELECT n_regionkey, least(a, b) AS lo, greatest(a, b) AS hi, sum(CASE WHEN a < b THEN 1 ELSE -1 END) AS net
      FROM d GROUP BY ALL HAVING net <> 0),
e AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY n_regionkey, a, b) AS id
  FROM (SELECT n_regionkey, CASE WHEN net > 0 THEN lo ELSE hi END AS a, CASE WHEN net > 0 THEN hi ELSE lo END AS b FROM u)),
t AS (SELECT x.id, y.id AS nxt,
             CAST(x.b[1] - x.a[1] AS DOUBLE) AS ux, CAST(x.b[2] - x.a[2] AS DOUBLE) AS uy,
             CAST(y.b[1] - y.a[1] AS DOUBLE) AS vx, CAST(y.b[2] - y.a[2] AS DOUBLE) AS vy
      FROM e x JOIN e y ON x.n_regionkey = y.n_regionkey AND x.b = y.a),
n AS MATERIALIZED (SELECT id, arg_max(nxt, atan2(ux * vy - uy * vx, ux * vx + uy * vy)) AS nxt FROM t GROUP BY id),
walk(id, cur) AS (SELECT id, id FROM e UNION SELECT w.id, n.nxt FROM walk w JOIN n ON n.id = w.cur),
ring AS (SELECT id, min(cur) AS head FROM walk GROUP BY id),
g AS (SELECT e.n_regionkey, head, count(*) AS n_vertices,
             sum(CAST(a[1] AS HUGEINT) * b[2] - CAST(b[1] AS HUGEINT) * a[2]) AS twice
      FROM e JOIN ring USING (id) GROUP BY ALL)
SELECT g.n_regionkey, {R6('e.a[1] / 1e9')} AS start_x, {R6('e.a[2] / 1e9')} AS start_y,
       CAST(n_vertices AS BIGINT) AS n_vertices, {R6('abs(twice) / 2e18')} AS area, twice < 0 AS is_hole
FROM g JOIN e ON e.id = g.head
""")
def a13_dissolve_rings(spark, sf_dir):
    """Neighbourhoods dissolved per region: the outlines of the union, holes
    included."""
    d = DS.dissolve_rings(polygons(spark, sf_dir), ["n_regionkey"])
    return d.select("n_regionkey", r6(d.ring[0]["x"]).alias("start_x"), r6(d.ring[0]["y"]).alias("start_y"),
                    "n_vertices", r6("area").alias("area"), "is_hole")


# -- catchment series (G6, A14, W1, A5), trend (D1), snapshots (D2) ---------------

def polygon_period_eqi(spark, sf_dir):
    """Per (neighbourhood, month): mean line score of the businesses inside."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", score(F.col("l_discount")).alias("q"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("q").alias("_sq"), F.count("q").alias("_cq"))
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
    per_cust = (o.join(per_order, o.o_orderkey == per_order.l_orderkey)
                .groupBy("o_custkey", "period").agg(F.sum("_sq").alias("_sq"),
                                                    F.sum("_cq").alias("_cq")))
    pts = business_points(spark, sf_dir).select("c_custkey", "lon", "lat")
    pts = pts.join(per_cust, pts.c_custkey == per_cust.o_custkey)
    j = SP.spatial_join(pts, polygons(spark, sf_dir), preserve="inner")
    return (j.groupBy("poly_id", "n_name", "n_regionkey", "period")
            .agg(F.try_divide(F.sum("_sq"), F.sum("_cq")).alias("eqi"),
                 F.count(F.lit(1)).alias("n_business")))


PERIOD_POLY_SQL = POINTS_SQL + "," + POLYS_SQL + f""",
pc AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
              sum(abs(l_discount) * 10.0) AS sq, count(*) AS cq
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ppe AS (SELECT g.poly_id, g.n_name, g.n_regionkey, pc.period, sum(sq) / sum(cq) AS eqi
        FROM pts p JOIN pc ON p.c_custkey = pc.o_custkey
             JOIN polys g ON {pip_sql('g.ring', 'p.lon', 'p.lat')}
        GROUP BY 1, 2, 3, 4),
disc AS (SELECT poly_id, n_name, n_regionkey FROM polys WHERE {DISC_SQL}),
ser AS (SELECT ppe.period, ppe.n_regionkey,
               CASE WHEN count(ppe.eqi) = count(*) THEN avg(ppe.eqi) END AS eqi, count(*) AS n
        FROM disc JOIN ppe ON disc.poly_id IS NOT DISTINCT FROM ppe.poly_id
                          AND disc.n_name IS NOT DISTINCT FROM ppe.n_name
                          AND disc.n_regionkey IS NOT DISTINCT FROM ppe.n_regionkey
        WHERE ppe.period IS NOT NULL GROUP BY 1, 2),
wx AS (SELECT period, 100 * sum(n * eqi) / sum(n) AS x FROM ser GROUP BY 1)
"""


def catchment_series(spark, sf_dir, weight: str = "rows"):
    """Neighbourhoods meeting the disc, joined (null-safe, on all shared
    keys) to their monthly series; per (month, region): mean eqi and ``n``,
    the number of joined neighbourhood rows or of their businesses."""
    disc = SP.polygons_within(polygons(spark, sf_dir), CAMPUS_LON, CAMPUS_LAT, RADIUS_M) \
        .drop("rings")
    ppe = polygon_period_eqi(spark, sf_dir)
    j = J.join_keys(disc, ppe, ["poly_id", "n_name", "n_regionkey"], "inner", null_safe=True)
    j = j.where(F.col("period").isNotNull())
    rows = A.group_stats(j, ["period", "n_regionkey"], "eqi", mean="eqi", sd=None)
    if weight == "rows":
        return rows
    if weight != "businesses":
        raise ValueError("weight is 'rows' or 'businesses'")
    held = j.groupBy("period", "n_regionkey").agg(F.sum("n_business").alias("n"))
    return J.join_keys(rows.drop("n"), held, ["period", "n_regionkey"], "inner", null_safe=True)


@query("g6_catchment_index", sql="WITH " + PERIOD_POLY_SQL + f"""
SELECT period, n_regionkey, {R6('eqi')} AS eqi, CAST(n AS BIGINT) AS n,
       {R6('100 * eqi / nullif(first_value(eqi) OVER (PARTITION BY n_regionkey ORDER BY period), 0)')}
         AS "index"
FROM ser
""")
def g6_catchment_index(spark, sf_dir):
    """Catchment series per region with the base-period index."""
    s = catchment_series(spark, sf_dir)
    s = W.base_index(s, "eqi", ["n_regionkey"], "period", out="index")
    return s.select("period", "n_regionkey", r6("eqi").alias("eqi"),
                    F.col("n").cast("long").alias("n"), r6("index").alias("index"))


def weighted_series(spark, sf_dir, weight: str = "rows"):
    """Monthly catchment index, weighted by joined neighbourhood rows (as the
    reference does) or by their businesses."""
    s = catchment_series(spark, sf_dir, weight)
    return s.groupBy("period").agg((100 * A.weighted_mean("eqi", "n")).alias("x"))


@query("a5_catchment_weighted", sql="WITH " + PERIOD_POLY_SQL + f"""
SELECT period, {R6('x')} AS x FROM wx
""")
def a5_catchment_weighted(spark, sf_dir):
    """Monthly catchment index: 100 * sum(n * eqi) / sum(n)."""
    return weighted_series(spark, sf_dir).withColumn("x", r6("x"))


def _trend_sql():
    return f"""
, xs AS (SELECT period, x, CAST(date_diff('day', DATE '1970-01-01', period) AS DOUBLE) AS d FROM wx
         WHERE x IS NOT NULL),
st AS (SELECT avg(d) AS mx, stddev_samp(d) AS sx FROM xs),
zz AS (SELECT period, x, (d - mx) / sx AS z FROM xs, st),
mo AS (SELECT CAST(count(*) AS DOUBLE) AS s0, sum(z) AS s1, sum(pow(z, 2)) AS s2,
              sum(pow(z, 3)) AS s3, sum(pow(z, 4)) AS s4, sum(x) AS t0, sum(z * x) AS t1,
              sum(pow(z, 2) * x) AS t2 FROM zz),
dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det
       FROM mo),
cf AS (SELECT (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS b0,
              (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS b1,
              (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS b2
       FROM dt)
SELECT period, {R6('x')} AS x, {R6('b0 + b1 * z + b2 * z * z')} AS trend FROM zz, cf
"""


@query("a14_weighted_by_businesses", sql="WITH " + PERIOD_POLY_SQL + f""",
nb AS (SELECT g.poly_id, pc.period, count(*) AS nb FROM pts p JOIN pc ON p.c_custkey = pc.o_custkey
            JOIN polys g ON {pip_sql('g.ring', 'p.lon', 'p.lat')} GROUP BY 1, 2),
held AS (SELECT nb.period, n_regionkey, sum(nb) AS n FROM nb JOIN disc USING (poly_id) GROUP BY 1, 2)
SELECT period, {R6('100 * sum(held.n * eqi) / sum(held.n)')} AS x FROM ser JOIN held USING (period, n_regionkey) GROUP BY 1
""")
def a14_weighted_by_businesses(spark, sf_dir):
    """The monthly catchment index weighted by businesses."""
    return weighted_series(spark, sf_dir, "businesses").withColumn("x", r6("x"))


@query("d1_quadratic_trend", sql="WITH " + PERIOD_POLY_SQL + _trend_sql())
def d1_quadratic_trend(spark, sf_dir):
    """Quadratic trend of the monthly catchment index."""
    t = T.poly_trend(weighted_series(spark, sf_dir).where(F.col("x").isNotNull()),
                     "period", "x", x_is_date=True)
    return t.select("period", r6("x").alias("x"), r6("trend").alias("trend"))


@query("d2_snapshot_years", sql="WITH " + PERIOD_POLY_SQL + f"""
SELECT period, CAST(year(period) AS INTEGER) AS year, n_regionkey, {R6('eqi')} AS eqi
FROM ser WHERE period IN ({", ".join(f"DATE '{d}'" for d in SNAPSHOTS)})
""")
def d2_snapshot_years(spark, sf_dir):
    """Snapshot months of the catchment series with their year (facets)."""
    s = catchment_series(spark, sf_dir)
    s = s.where(r_in("period", [F.lit(d).cast("date") for d in SNAPSHOTS]))
    return s.select("period", F.year("period").alias("year"), "n_regionkey",
                    r6("eqi").alias("eqi"))
