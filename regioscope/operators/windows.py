"""Window-style operators expressed without unbounded window partitions.

A ``Window.partitionBy(k)`` sorts a whole key group inside one task, and an
un-partitioned window moves the whole table into one task.  The operators
below get the same answers from partial aggregates joined back (or from a
bounded top-k scalar subquery), so a hot key never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regioscope.functions.rsem import safe_div
from regioscope.operators.joins import join_keys
from regioscope.session import cut_lineage


def base_index(df: DataFrame, value: str, by: Sequence[str], order: str,
               out: str = "index", scale: float = 100.0) -> DataFrame:
    """``scale * x / first(x)`` within each group, first by ``order``.

    The base value is ``min_by(x, order)`` per group (a partial aggregate),
    joined back on the group key (null-safe, as dplyr groups NA together).
    """
    base = df.groupBy(*by).agg(F.min_by(value, order).alias("_base"))
    joined = join_keys(df, base, by, "left", null_safe=True)
    return joined.withColumn(out, scale * safe_div(F.col(value), F.col("_base"))) \
        .drop("_base")


def share_within(df: DataFrame, value: str, by: Sequence[str],
                 out: str = "percentage") -> DataFrame:
    """``x / sum(x)`` within each group."""
    tot = df.groupBy(*by).agg(F.sum(value).alias("_tot"))
    joined = join_keys(df, tot, by, "left", null_safe=True)
    return joined.withColumn(out, safe_div(F.col(value), F.col("_tot"))).drop("_tot")


def top_n_with_ties(df: DataFrame, n: int, wt: str, materialize: bool = True) -> DataFrame:
    """``top_n(n, wt)``: every row whose ``wt`` ranks within the top n,
    ties at the boundary kept (``min_rank(desc(wt)) <= n``).

    The n-th largest value comes from a distributed take-ordered of n rows
    (a bounded scalar subquery); the table itself is only filtered.  The
    input is read twice (subquery + filter), so by default it is written
    once to the checkpoint folder instead of being computed twice.
    """
    if materialize:
        df = cut_lineage(df)
    kth = df.select(wt).where(F.col(wt).isNotNull()) \
        .orderBy(F.col(wt).desc()).limit(n).agg(F.min(wt)).scalar()
    return df.where(F.col(wt) >= kth)


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "",
           materialize: bool = True) -> DataFrame:
    """Column z-scores with the sample sd (``scale()``); sd 0 -> NULL.
    One aggregate pass gives all moments (merged scalar subqueries)."""
    if materialize:
        df = cut_lineage(df)
    moments = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"))
                       .alias(c) for c in cols])
    out = df
    for c in cols:
        m = moments.select(F.col(c)["m"]).scalar()
        s = moments.select(F.col(c)["s"]).scalar()
        out = out.withColumn(c + suffix, safe_div(F.col(c) - m, s))
    return out


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: the row's place (from 1) in the total order of
    ``order``, which should end in a key that tells rows apart.

    No single-task window: rows are range-partitioned, numbered within their
    slice, and shifted by the rows of the slices before (one small table of a
    row per slice).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut_lineage(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))
    w = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    before = (d.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
              .select(F.col("_slice").alias("_of"), F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return (d.withColumn("_own", own).join(F.broadcast(before), F.col("_slice") == F.col("_of"))
            .withColumn(out, F.col("_before") + F.col("_own")).drop("_slice", "_of", "_own", "_before"))
