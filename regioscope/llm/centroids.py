"""Centroid clustering with exact integers, in DataFrame functions.

Components are scaled to integers.  A round is one job: ``zip_with`` and
``aggregate`` compute the squared distances of a vector to the centroids,
which are literal arrays in the plan, ``array_min`` of (distance, number)
structs chooses the cluster, and one column sum per component, combined
before the shuffle, gives the new centroids.  Only ``k`` rows of sums reach
the driver, and a hot cluster is no hot task, since every input task adds up
its own rows first.

Integers make the result exact: no order of addition changes it.

Vectors of another length, null ones and those with a null or non-finite
component take no part and have no row.  A repeated row counts as often as
it occurs; a row without an id is clustered but starts a cluster only when
too few others are there.  With fewer than ``k`` vectors there are as many
clusters; without any the result is empty.  Scaled components beyond
+-2**27 count as 2**27, so that distances fit 64 bits; sums of distances
beyond that are null.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import materialize

LARGEST = 1 << 27


def scaled(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors as integer arrays."""
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where((F.size("x") == dim) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x)
                                                   & (F.abs(x) != float("inf"))))
            .select("id", F.transform("x", lambda x: F.greatest(
                F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale)))).alias("v")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of their id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [list(r["v"]) for r in first]


def nearest(v: str, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the centroid nearest to column ``v``; ties go
    to the smaller number."""
    parts = (f"struct(aggregate(zip_with({v}, array({', '.join(f'{x}L' for x in c)}), (a, b) -> (a - b) * (a - b)), 0L, "
             f"(s, x) -> s + x) AS distance, {i} AS cluster)" for i, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(parts)}))")


def next_centroids(rows: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Componentwise floor(sum / count) of every cluster; an empty one
    stays."""
    sums = (rows.select(nearest("v", centroids)["cluster"].alias("cluster"), "v")
            .selectExpr("cluster", *(f"v[{j}] AS c{j}" for j in range(dim)))
            .groupBy("cluster").agg(F.count("*").alias("n"), *(F.expr(f"sum(c{j}) AS c{j}") for j in range(dim))))
    out = list(centroids)
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [r[f"c{j}"] // r["n"] for j in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector and the final
    centroids."""
    rows = scaled(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        none = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return none.where("false"), []
    for _ in range(rounds):
        moved = next_centroids(rows, centroids, dim)
        if moved == centroids:  # every later round would repeat this one
            break
        centroids = moved
    own = nearest("v", centroids)
    rows = rows.select("id", own.alias("own"))
    return rows.select(F.col("id").alias(id_col), F.col("own.cluster").alias("cluster"),
                       F.col("own.distance").alias("distance")), centroids


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, inertia of the cluster and of all, and the
    hash of the cluster's centroid."""
    rows, centroids = cluster(vectors)
    rows = materialize(rows, "clusters")
    sums = {r["cluster"]: r["inertia"] for r in  # at most k rows
            rows.groupBy("cluster").agg(F.try_sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    inertia = _long(sum(sums.values()))
    of_cluster = F.array(*(_long(sums.get(i, 0)) for i in range(len(centroids))))
    named = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids))
    if not centroids:
        of_cluster, named = of_cluster.cast("array<bigint>"), named.cast("array<string>")
    return rows.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance",
                       F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"), inertia.alias("inertia"),
                       F.get(named, F.col("cluster")).alias("centroid_sha256"))


def _long(n) -> Column:
    return F.lit(int(n) if n < 1 << 63 else None).cast("bigint")
