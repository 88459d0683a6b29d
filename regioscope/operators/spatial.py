"""Spatial joins on DataFrames (points in polygons, polygons near a point).

Spark has no spatial index or predicates, so the join is an equi-join on
grid cells followed by an exact crossing test:

* polygons become rows of an edge index (``edge_index``): per cell the edges
  that touch it and whether its corner is inside;
* every point computes its own cell;
* points and index rows meet on ``(gx, gy)``; the even-odd test runs only on
  the edges of the point's cell.

The index is broadcast only when rows and bytes are measured to be under
their bounds; beyond that the join is a shuffle join on (cell, salt): points
of hot cells (more than ``hot_cell_rows`` points, found by a partial count)
get one of ``ceil(points / hot_cell_rows)`` salts from a hash of their columns
and those cells' index rows are replicated per salt, so a dense cell (a
downtown) is spread over many tasks while ordinary cells join unsalted.
Points without coordinates go round the join.  Pick ``cell`` so a cell holds
few polygons; the point side is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.functions import geo as G
from regioscope.operators.edge_index import column_of, edge_index, line_of, point_in_cell
from regioscope.operators.joins import is_small
from regioscope.session import cut_lineage


def polygon_cells(polygons: DataFrame, cell: float, rings: str = "rings", poly_id: str = "poly_id") -> DataFrame:
    """The edge index, written once: it is measured before it is joined."""
    return cut_lineage(edge_index(polygons, cell, rings, poly_id))


def spatial_join(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat",
                 rings: str = "rings", poly_id: str = "poly_id", preserve: str = "points",
                 cell: float = 0.02, max_broadcast_rows: int = 2_000_000,
                 hot_cell_rows: int = 1_000_000) -> DataFrame:
    """Attach to each point the polygons that contain it (``st_join``).

    ``preserve='points'``: every point kept; unmatched points (or NULL
    coordinates) get NULL polygon columns.  ``preserve='polygons'``: every
    polygon kept; a polygon without points gets one row of NULL point
    columns.  ``'inner'``: matched pairs only.  The ``rings`` column is
    not carried into the output.  ``poly_id`` names one polygon each.
    """
    cells = polygon_cells(polygons, cell, rings, poly_id).withColumnRenamed(poly_id, "_pid")
    small = is_small(cells, max_broadcast_rows)
    pts = points.selectExpr("*", f"{column_of(f'`{lon}`', cell)} AS _gx", f"{line_of(f'`{lat}`', cell)} AS _gy")
    nowhere = pts.where(F.col("_gx").isNull() | F.col("_gy").isNull()).select(*points.columns)
    pts = pts.where(F.col("_gx").isNotNull() & F.col("_gy").isNotNull())
    if not small:
        # a dense cell would be one task: salt the points of hot cells and
        # replicate those cells' index rows once per salt
        hot = (pts.groupBy("_gx", "_gy").agg(F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > hot_cell_rows)
               .select("_gx", "_gy", F.ceil(F.col("_n") / hot_cell_rows).cast("int").alias("_salts")))
        hot = F.broadcast(hot)
        salts = F.coalesce("_salts", F.lit(1))
        pts = pts.join(hot, ["_gx", "_gy"], "left") \
            .withColumn("_salt", F.pmod(F.xxhash64(*points.columns), salts).cast("int")).drop("_salts")
        cells = cells.join(hot, ["_gx", "_gy"], "left") \
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    cells = cells.withColumnsRenamed({"_gx": "_cx", "_gy": "_cy", "_salt": "_cs"})
    cond = F.expr("_gx = _cx AND _gy = _cy" + ("" if small else " AND _salt = _cs")) & point_in_cell(lon, lat, cell)
    if small:
        cells = F.broadcast(cells)
    polys = polygons.drop(rings)
    matched = pts.join(cells, cond, "left" if preserve == "points" else "inner").select(
        *[pts[c] for c in points.columns], cells["_pid"])
    if preserve == "polygons":
        return polys.join(matched, polys[poly_id].eqNullSafe(matched["_pid"]), "left").drop("_pid")
    if preserve == "inner":
        return matched.join(polys, matched["_pid"].eqNullSafe(polys[poly_id])).drop("_pid")
    out = matched.join(polys, matched["_pid"] == polys[poly_id], "left").drop("_pid")
    return out.union(nowhere.select(*points.columns, *[
        F.lit(None).cast(polygons.schema[c].dataType).alias(c) for c in polys.columns]))


def polygons_within(polygons: DataFrame, lon0: float, lat0: float, radius_m: float,
                    rings: str = "rings") -> DataFrame:
    """Polygons that meet the disc of ``radius_m`` metres around
    (lon0, lat0) (``st_intersection`` with a buffer, as a predicate).

    A bounding-box test in degrees prunes first; the exact test is the
    centre-inside / nearest-edge-distance expression.  No join: the disc is
    a constant.
    """
    import math
    dlat = radius_m / (G.EARTH_RADIUS_M * math.pi / 180.0)
    dlon = dlat / max(1e-9, math.cos(math.radians(lat0)))
    bb = G.bbox(rings)
    near = ((bb["maxx"] >= lon0 - dlon) & (bb["minx"] <= lon0 + dlon)
            & (bb["maxy"] >= lat0 - dlat) & (bb["miny"] <= lat0 + dlat))
    return polygons.where(near & G.polygon_meets_disc(rings, lon0, lat0, radius_m))
