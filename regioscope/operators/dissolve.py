"""Union of polygons per group, as joins over their edges.

Polygons of a coverage share whole edges with their neighbours.  An edge that
two polygons of a group run through in opposite directions lies inside the
union and cancels; what is left are the outlines, holes included.  They are
stitched to rings by pointer jumping: every edge knows the edge that follows,
and in each round takes over what the edge it points to knows, so a ring of n
edges needs log2(n) rounds, each one join of the edges with themselves.  No
step gathers a group; a ring is one row of the result, as any geometry is.

Where several outlines meet in a point, the sharpest left turn is taken
(the inside lies to the left), which keeps polygons that touch in a point
apart.

Edges must match: where a vertex of one polygon lies within an edge of its
neighbour, the edge does not cancel.  Overlapping polygons are no coverage;
edges that run twice in one direction count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.operators.joins import join_keys
from regioscope.session import cut_lineage


def _twice_area(ring: Column) -> Column:
    first = ring[0]  # relative to a vertex, so that far coordinates do not cancel
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s
                       + (ring[i]["x"] - first["x"]) * (ring[i + 1]["y"] - first["y"])
                       - (ring[i + 1]["x"] - first["x"]) * (ring[i]["y"] - first["y"]))


def polygon_edges(df: DataFrame, by: Sequence[str], rings: str, digits: int) -> DataFrame:
    """(by..., ax, ay, bx, by_): every edge with the polygon on its left, in
    units of the last digit."""
    r = df.select(*by, F.posexplode(rings).alias("_k", "_ring")).where(F.size("_ring") > 2)
    shell = F.col("_k") == 0
    turned = (_twice_area(F.col("_ring")) > 0) != shell
    r = r.select(*by, F.when(turned, F.reverse("_ring")).otherwise(F.col("_ring")).alias("_ring"))
    unit = 10.0 ** digits
    point = lambda p: F.struct(*(F.round(p[c] * unit).cast("long").alias(c) for c in "xy"))
    r = r.withColumn("_ring", F.transform("_ring", point))
    pair = F.zip_with(F.slice("_ring", F.lit(1), F.size("_ring") - 1), F.slice("_ring", F.lit(2), F.size("_ring") - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = r.select(*by, F.explode(pair).alias("e")).where("e.a != e.b")
    return e.select(*by, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
                    F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by_"))


def outline(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """The edges that no other edge of the group cancels."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"))
    net = (edges.select(*by, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"),
                        F.when(a < b, 1).otherwise(-1).alias("way"))
           .groupBy(*by, "lo", "hi").agg(F.sum("way").alias("net")).where("net != 0"))
    ahead = F.col("net") > 0
    start, end = F.when(ahead, F.col("lo")).otherwise(F.col("hi")), F.when(ahead, F.col("hi")).otherwise(F.col("lo"))
    return net.select(*by, start["x"].alias("ax"), start["y"].alias("ay"), end["x"].alias("bx"), end["y"].alias("by_"))


def _next_edges(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """(id, next): the edge that follows, by the sharpest left turn."""
    here = e.select(*by, F.col("bx").alias("ax"), F.col("by_").alias("ay"), "id",
                    (F.col("bx") - F.col("ax")).cast("double").alias("ux"), (F.col("by_") - F.col("ay")).cast("double").alias("uy"))
    there = e.select(*by, "ax", "ay", F.col("id").alias("next"),
                     (F.col("bx") - F.col("ax")).cast("double").alias("vx"), (F.col("by_") - F.col("ay")).cast("double").alias("vy"))
    met = join_keys(here, there, [*by, "ax", "ay"], "inner", null_safe=True)
    turn = F.atan2(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx"), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))
    return met.groupBy("id").agg(F.max_by("next", turn).alias("next"))


def _rings_of(e: DataFrame, by: Sequence[str]) -> DataFrame:
    """(id, head, steps): the ring's first edge and how many edges lie from
    this edge to the ring's last."""
    first = F.struct("ax", "ay", "bx", "by_", "id")
    known = cut_lineage(e.join(_next_edges(e, by), "id").select("id", "next", first.alias("head")))
    state, before = known.select("id", F.col("next").alias("jump"), "head"), None
    while True:  # the smallest edge of each ring
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("head").alias("seen"))
        state = cut_lineage(state.join(ahead, "jump").select(
            "id", F.col("far").alias("jump"), F.least("head", "seen").alias("head")))
        now = state.agg(F.sum(F.xxhash64("id", "head").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    heads = state.select("id", F.col("head.id").alias("head"))
    # cut every ring before its first edge and count the steps to its end
    chain = known.select("id", "next").join(heads, "id")
    chain = cut_lineage(chain.select("id", "head", F.when(F.col("next") != F.col("head"), F.col("next")).alias("jump"),
                                     F.when(F.col("next") != F.col("head"), 1).otherwise(0).cast("long").alias("steps")))
    while chain.where("jump is not null").limit(1).count():
        ahead = chain.select(F.col("id").alias("at"), F.col("jump").alias("far"), F.col("steps").alias("more"))
        chain = cut_lineage(chain.join(ahead, F.col("jump") == F.col("at"), "left").select(
            "id", "head", F.col("far").alias("jump"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return chain.select("id", "head", "steps")


def dissolve_rings(df: DataFrame, by: Sequence[str], rings: str = "rings", digits: int = 9) -> DataFrame:
    """(by..., ring, n_vertices, area, is_hole): the outlines of each group's
    union, one row a ring.

    Rings are closed, begin at their smallest vertex and have the inside on
    their left, so a hole runs clockwise; ``area`` is positive for both.  All
    rings of a group together are its geometry under the even-odd rule.
    Vertices are rounded to ``digits`` places.  Rows without rings add
    nothing; a group without any has no row.  NULL is a key like any other.
    """
    by = list(by)
    e = cut_lineage(outline(polygon_edges(df, by, rings, digits), by).withColumn("id", F.monotonically_increasing_id()))
    placed = e.join(_rings_of(e, by), "id")
    unit = 10.0 ** digits
    at = F.struct((-F.col("steps")).alias("at"), (F.col("ax") / unit).alias("x"), (F.col("ay") / unit).alias("y"))
    found = placed.groupBy(*by, "head").agg(F.sort_array(F.collect_list(at)).alias("p"))
    open_ = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = found.select(*by, F.concat(open_, F.slice(open_, 1, 1)).alias("ring"))
    area = _twice_area(F.col("ring")) / 2
    return closed.select(*by, "ring", (F.size("ring") - 1).cast("long").alias("n_vertices"),
                         F.abs(area).alias("area"), (area < 0).alias("is_hole"))
