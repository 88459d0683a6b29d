"""Polynomial trend of a series (``lm(y ~ poly(x, 2))``) as aggregates.

Per group: the mean and sd of x (one aggregate), then the moment sums of
the standardised x (a second aggregate), a closed-form 3 x 3 solve in
column arithmetic, and the fitted values joined back.  Only per-group
moment rows move; no group is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.functions.rsem import safe_div
from regioscope.operators.joins import broadcast_if_small
from regioscope.session import cut_lineage


def _det3(a, b, c, d, e, f, g, h, i) -> Column:
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def poly_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = (),
               out: str = "trend", x_is_date: bool = False) -> DataFrame:
    """Quadratic least-squares trend of ``y`` on ``x`` per group; adds
    ``out`` (fitted value).  Fewer than 3 distinct x in a group -> NULL."""
    by = list(by)
    xv = F.datediff(F.col(x), F.lit("1970-01-01").cast("date")).cast("double") \
        if x_is_date else F.col(x).cast("double")
    # the input is read by three aggregates and the final join: written once
    d = cut_lineage(df.withColumn("_x", xv).withColumn("_y", F.col(y).cast("double")))
    obs = d.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    st = obs.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.stddev_samp("_x").alias("_sx"))
    z = safe_div(F.col("_x") - F.col("_mx"), F.col("_sx"))
    o = obs.join(broadcast_if_small(st), by) if by else obs.withColumns(
        {"_mx": st.select("_mx").scalar(), "_sx": st.select("_sx").scalar()})
    o = o.withColumn("_z", z)
    mom = o.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum("_z").alias("s1"),
        F.sum(F.pow("_z", 2)).alias("s2"), F.sum(F.pow("_z", 3)).alias("s3"),
        F.sum(F.pow("_z", 4)).alias("s4"), F.sum("_y").alias("t0"),
        F.sum(F.col("_z") * F.col("_y")).alias("t1"),
        F.sum(F.pow("_z", 2) * F.col("_y")).alias("t2"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in
                                      ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = _det3(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    coef = mom.select(
        *by,
        safe_div(_det3(t0, s1, s2, t1, s2, s3, t2, s3, s4), det).alias("_b0"),
        safe_div(_det3(s0, t0, s2, s1, t1, s3, s2, t2, s4), det).alias("_b1"),
        safe_div(_det3(s0, s1, t0, s1, s2, t1, s2, s3, t2), det).alias("_b2"))
    coef = coef.join(st, by) if by else coef.withColumns(
        {"_mx": st.select("_mx").scalar(), "_sx": st.select("_sx").scalar()})
    res = d.join(broadcast_if_small(coef), by, "left") if by else d.withColumns(
        {c: coef.select(c).scalar() for c in ("_b0", "_b1", "_b2", "_mx", "_sx")})
    zz = safe_div(F.col("_x") - F.col("_mx"), F.col("_sx"))
    fitted = F.col("_b0") + F.col("_b1") * zz + F.col("_b2") * zz * zz
    return res.withColumn(out, fitted).drop("_x", "_y", "_b0", "_b1", "_b2", "_mx", "_sx")
