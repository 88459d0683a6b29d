"""Sources and sinks exercised end to end on data Spark derives from the
driver tables: written to the shared checkpoint folder, read back with a
declared schema, keyed from file names, and aggregated."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from regioscope.plans.bindings import load, polygons, r6, score
from regioscope.plans.geo import POLYS_SQL
from regioscope.plans.registry import R6, query
from regioscope.sources import io as IO
from regioscope.streaming import snapshots as ST


def _snapshot_lines(spark, sf_dir):
    """Scored lines with nation, region label and snapshot folder key."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", score(F.col("l_discount")).alias("q"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = F.broadcast(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
         .join(n, F.col("c_nationkey") == n.n_nationkey)
         .join(r, F.col("n_regionkey") == r.r_regionkey))
    return j.select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("cve_mun"),
                    F.concat(F.lit("Región "), F.col("r_name")).alias("region_label"),
                    "q", F.date_format("o_orderdate", "MMyyyy").alias("snap"))


_SNAP_SCHEMA = "cve_mun string, region_label string, q double"

_SNAP_SQL = f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
       lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cve_mun, 'Región ' || r_name AS region_label,
       {R6('avg(abs(l_discount) * 10.0)')} AS mean_value, CAST(count(*) AS BIGINT) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2, 3
"""


@query("s4_snapshot_csv_roundtrip", sql=_SNAP_SQL)
def s4_snapshot_csv_roundtrip(spark, sf_dir):
    """Lines written as Latin-1 CSV, one folder per
    month (dynamic partition overwrite), read back as one table with a
    string schema (``09`` stays ``09``), month taken from the folder name,
    then mean score and count per (month, nation, region label)."""
    path = IO.scratch_path(spark, "snapshots")
    IO.write_csv(_snapshot_lines(spark, sf_dir), path, partition_by=["snap"],
                 encoding="ISO-8859-1")
    df = IO.read_csv(spark, path, _SNAP_SCHEMA, encoding="ISO-8859-1", with_path=True)
    df = IO.with_period_from_path(df, component=-2, digits=6)
    # a named table queried through SQL (S6); Catalyst plans it the same way
    IO.register(df, "snapshot_lines", cache=False)
    g = spark.sql("""
        SELECT period, cve_mun, region_label, avg(q) AS mean_value, count(*) AS n
        FROM snapshot_lines GROUP BY period, cve_mun, region_label""")
    return g.withColumn("mean_value", r6("mean_value"))


@query("s4_snapshot_stream", sql=_SNAP_SQL)
def s4_snapshot_stream(spark, sf_dir):
    """The per-file loop as an incremental file stream (availableNow):
    partial sums per batch appended, merged at the end."""
    src = IO.scratch_path(spark, "snap-src")
    IO.write_csv(_snapshot_lines(spark, sf_dir), src, partition_by=["snap"],
                 encoding="ISO-8859-1")
    out, ck = IO.scratch_path(spark, "snap-out"), IO.scratch_path(spark, "snap-ck")
    ST.ingest_snapshots(spark, src, _SNAP_SCHEMA, ["cve_mun", "region_label"], "q", out, ck,
                        encoding="ISO-8859-1", digits=6, component=-2)
    g = ST.rollup(spark, out, ["cve_mun", "region_label"])
    return g.select("period", "cve_mun", "region_label", r6("mean_value").alias("mean_value"),
                    F.col("n").cast("long").alias("n"))


@query("s9_polygon_layer_roundtrip", sql="WITH " + POLYS_SQL + f"""
SELECT CAST(poly_id AS VARCHAR) AS poly_id, n_name, CAST(len(ring) AS INTEGER) AS n_vertices,
       {R6('list_min(list_transform(ring, lambda p: p.x))')} AS minx,
       {R6('list_max(list_transform(ring, lambda p: p.y))')} AS maxy
FROM polys
""")
def s9_polygon_layer_roundtrip(spark, sf_dir):
    """The polygon layer written as GeoJSON features and read back
    into ring arrays."""
    path = IO.scratch_path(spark, "polygons")
    IO.write_polygons(polygons(spark, sf_dir), path, ["poly_id", "n_name"])
    p = IO.read_polygons(spark, path, ["poly_id", "n_name"])
    xs = F.transform(F.col("rings")[0], lambda q: q["x"])
    ys = F.transform(F.col("rings")[0], lambda q: q["y"])
    return p.select("poly_id", "n_name", F.size(F.col("rings")[0]).alias("n_vertices"),
                    r6(F.array_min(xs)).alias("minx"), r6(F.array_max(ys)).alias("maxy"))
