"""Grid index of polygon edges.

A cell row holds what decides about points in that cell and no more: the
edges that touch the cell, and whether its upper right corner lies inside the
polygon.  A point is inside if the corner is, as often as the way from the
point to the corner (right to the cell's wall, then up along it) meets
edges.  A polygon of n edges over c cells so costs about n + c short rows,
not c copies of its rings; cells that lie within it have no edges at all.

The corners come from a scan along each line of cells: the edges that cross
the line's upper border cut it into runs that are inside or outside by turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the grid begins, in cells: off the round numbers that data favour, so
#: that no edge runs through the corner of a cell.
SHIFT_X, SHIFT_Y = 2 ** 0.5 - 1, 3 ** 0.5 - 1


def column_of(x: str, cell: float) -> str:
    """The column of cells of an x, as SQL."""
    return f"CAST(floor(({x}) / {cell!r}D - {SHIFT_X!r}D) AS BIGINT)"


def line_of(y: str, cell: float) -> str:
    return f"CAST(floor(({y}) / {cell!r}D - {SHIFT_Y!r}D) AS BIGINT)"


def ring_edges(polygons: DataFrame, rings: str, key: str) -> DataFrame:
    """(key, xa, ya, xb, yb) of every edge of every ring."""
    return (polygons.selectExpr(f"`{key}`", f"explode(`{rings}`) AS _r").where("size(_r) > 1")
            .selectExpr(f"`{key}`", "inline(zip_with(slice(_r, 1, size(_r) - 1), slice(_r, 2, size(_r) - 1), (a, b) -> "
                        "struct(a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb)))"))


def edge_index(polygons: DataFrame, cell: float, rings: str, key: str) -> DataFrame:
    """(key, _gx, _gy, _corner, _edges): the cells of every polygon."""
    pad = f"{cell * 1e-6!r}D"
    at = "xa + (xb - xa) * try_divide({0} - ya, yb - ya)"  # where the edge's line meets a height
    e = ring_edges(polygons, rings, key).selectExpr(
        "*", f"explode(sequence({line_of(f'least(ya, yb) - {pad}', cell)}, {line_of(f'greatest(ya, yb) + {pad}', cell)})) AS _gy")
    e = e.selectExpr("*", f"(_gy + {SHIFT_Y!r}D) * {cell!r}D AS _low", f"(_gy + {1 + SHIFT_Y!r}D) * {cell!r}D AS _top")
    # the part of the edge within its line of cells; a padded line may lie just
    # beyond the edge, whose part there is its end
    part = e.selectExpr("*", "least(greatest(least(ya, yb), _low), greatest(ya, yb)) AS _y0",
                        "greatest(least(greatest(ya, yb), _top), least(ya, yb)) AS _y1")
    part = part.selectExpr("*", f"if(ya = yb, xa, {at.format('_y0')}) AS _x0", f"if(ya = yb, xb, {at.format('_y1')}) AS _x1")
    touched = part.selectExpr(
        f"`{key}`", f"explode(sequence({column_of(f'least(_x0, _x1) - {pad}', cell)}, "
        f"{column_of(f'greatest(_x0, _x1) + {pad}', cell)})) AS _gx", "_gy", "struct(xa, ya, xb, yb) AS _edge", "false AS _corner")
    cuts = (e.where("(ya > _top) != (yb > _top)").selectExpr(f"`{key}`", "_gy", f"{column_of(at.format('_top'), cell)} AS _gx")
            .groupBy(key, "_gy", "_gx").agg(F.expr("count(*) AS _n")))
    over = f"OVER (PARTITION BY `{key}`, _gy ORDER BY _gx)"  # the cells of one polygon in one line
    runs = cuts.selectExpr(f"`{key}`", "_gy", "_gx", f"lead(_gx) {over} AS _to", f"sum(_n) {over} AS _before")
    # the number of cuts of a line is even: so many to the right as to the left, modulo 2
    inside = (runs.where("_before % 2 = 1 AND _to IS NOT NULL")
              .selectExpr(f"`{key}`", "explode(sequence(_gx, _to - 1)) AS _gx", "_gy",
                          "CAST(NULL AS struct<xa: double, ya: double, xb: double, yb: double>) AS _edge", "true AS _corner"))
    return (touched.union(inside).groupBy(key, "_gx", "_gy")
            .agg(F.expr("max(_corner) AS _corner"), F.expr("collect_list(_edge) AS _edges")))


def point_in_cell(lon: str, lat: str, cell: float) -> Column:
    """Is a point of the cell inside the polygon?  Over the columns of the
    index and of points, both with the cell's ``_gx`` and ``_gy``."""
    right, top = f"(_gx + {1 + SHIFT_X!r}D) * {cell!r}D", f"(_gy + {1 + SHIFT_Y!r}D) * {cell!r}D"
    px, py = f"`{lon}`", f"`{lat}`"
    at_x = f"e.xa + (e.xb - e.xa) * try_divide({py} - e.ya, e.yb - e.ya)"
    at_y = f"e.ya + (e.yb - e.ya) * try_divide({right} - e.xa, e.xb - e.xa)"
    level = f"(e.ya > {py}) != (e.yb > {py}) AND {px} < {at_x} AND {at_x} <= {right}"
    wall = f"(e.xa > {right}) != (e.xb > {right}) AND {py} < {at_y} AND {at_y} <= {top}"
    return F.expr(f"aggregate(_edges, _corner, (inside, e) -> inside != (coalesce({level}, false) != coalesce({wall}, false)))")
