"""Grouped aggregation operators (all partial-aggregating, skew-safe).

Every operator here is a ``groupBy().agg()`` whose aggregate functions
support map-side partial aggregation, so a hot key (even one holding a
third of the rows) is combined inside each input task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.functions.rsem import fill_na, nan_to_null, r_mean, r_sd, safe_div


def group_stats(df: DataFrame, by: Sequence[str], value: str,
                mean: str = "quality_index", sd: str | None = "std_dev",
                n: str = "n", na_rm: bool = False) -> DataFrame:
    """Mean, sample sd and row count per group (``summarise(mean, sd, n())``).

    ``na_rm=False`` keeps R's rule that one missing value makes the mean
    missing; the count always counts rows, scored or not.
    """
    aggs = [r_mean(value, na_rm).alias(mean)]
    if sd:
        aggs.append(r_sd(value, na_rm).alias(sd))
    aggs.append(F.count(F.lit(1)).alias(n))
    return df.groupBy(*by).agg(*aggs)


def cohort_potential(df: DataFrame, q: str = "quality_index", n: str = "n",
                     out: str = "cohort_potential",
                     percent: bool = False) -> DataFrame:
    """Empty-group repair, then cohort potential.

    The order is part of the contract: ``n`` is zeroed where ``q`` is
    missing *before* ``q`` is filled with 0; then ``cohort = n * q``;
    ``percent`` finally rescales ``q`` by 100.
    """
    qn = nan_to_null(q)
    df = df.withColumn(n, F.when(qn.isNull(), F.lit(0)).otherwise(F.col(n)))
    df = df.withColumn(q, fill_na(q, 0.0))
    df = df.withColumn(out, F.col(n) * F.col(q))
    if percent:
        df = df.withColumn(q, F.col(q) * 100.0)
    return df


def weighted_mean(value, weight) -> Column:
    """``sum(w * x) / sum(w)`` as an aggregate; NULL when weights sum to 0."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return safe_div(F.sum(w * v), F.sum(w))


def period_rollup(df: DataFrame, by: Sequence[str], value: str = "eqi",
                  n: str = "n", mean: str = "eqi", sd: str = "std",
                  total: str = "n") -> DataFrame:
    """Unweighted mean of group means, their sd, and the summed counts."""
    return df.groupBy(*by).agg(r_mean(value).alias(mean),
                               r_sd(value).alias(sd),
                               F.sum(n).alias(total))


def sum_by(df: DataFrame, column: str, value: str = "value",
           out: str = "gross_value_added", name: str = "name") -> DataFrame:
    """Grouped sum by a column chosen at call time."""
    return df.groupBy(F.col(column).alias(name)).agg(F.sum(value).alias(out))


def frequency(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    """Frequency table of one category (``table()``)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(n))


def correlation_long(df: DataFrame, cols: Sequence[str], n: str | None = None) -> DataFrame:
    """Pairwise Pearson correlation of ``cols`` as ``(var1, var2, corr)``,
    with the number of rows as column ``n`` if named.

    One aggregation pass computes all k(k+1)/2 moments.  As in R a missing
    value in either column makes the correlation missing; constant columns
    give NULL instead of a division error.  Output has k*k rows.
    """
    cols = list(cols)
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            whole = F.count_if(nan_to_null(x).isNull() | nan_to_null(y).isNull()) == 0
            aggs.append(F.when(whole, safe_div(F.covar_samp(x, y),
                                               F.stddev_samp(x) * F.stddev_samp(y)))
                        .alias(f"{i}_{cols.index(b)}"))
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"{min(i, j)}_{max(i, j)}"
            size = [F.col("_rows").alias(n)] if n else []
            pairs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                  F.col(key).alias("corr"), *size))
    return wide.select(F.inline(F.array(*pairs)))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column profile (``summary``): n, NA count, mean, sd, min, quartiles
    (R's type 7, exact at every size) and max, one row per column.

    Quartiles come from the positions of the distinct values in a
    distributed sort; no task or aggregate holds a whole column.
    """
    from regioscope.operators.composite import value_positions
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(x.isNull()).alias("n_missing"),
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
            F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    base = df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
        for c in cols]))).where("x is not null")
    sizes = base.select("column", (F.col("n") - F.col("n_missing")).alias("m"))
    at = value_positions(long, "column", "x").join(F.broadcast(sizes), "column")  # one row per column
    parts = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        h = (F.col("m") - 1) * p
        for end, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
            parts.append(F.max(F.when(inside, F.col("x"))).alias(f"{name}_{end}"))
        parts.append(F.first(h - F.floor(h)).alias(f"{name}_part"))
    found = at.groupBy("column").agg(*parts)
    quart = [(F.col(f"{q}_lo") + F.col(f"{q}_part") * (F.col(f"{q}_hi") - F.col(f"{q}_lo"))).alias(q)
             for q in ("q1", "median", "q3")]
    return base.join(found, "column", "left").select("column", "n", "n_missing", "mean", "sd", "min",
                                                     *quart, "max")


def dissolve(df: DataFrame, by: Sequence[str], rings: str = "rings",
             n: str = "n") -> DataFrame:
    """Dissolve polygons per group: the group's extent and its row count.

    The union shape itself is only ever drawn; what later steps use is the
    count (``n``) and the extent, both bounded partial aggregates, so no
    group's geometry is gathered into one task.
    """
    from regioscope.functions.geo import bbox
    b = bbox(rings)
    return (df.withColumn("_bb", b).groupBy(*by)
            .agg(F.min("_bb.minx").alias("minx"), F.min("_bb.miny").alias("miny"),
                 F.max("_bb.maxx").alias("maxx"), F.max("_bb.maxy").alias("maxy"),
                 F.count(F.lit(1)).alias(n)))
