"""Composite indicator operators (product A).

* ``p2_index``            Pena's P2 distance with iterative indicator order
* ``discrimination``      Ivanovic discrimination coefficient per indicator
* ``cum_root_f``          Dalenius-Hodges cumulative sqrt(f) strata
* ``stratum_labels``      ordered labels for the strata

Data stays distributed: the only driver-side objects are k x k moment
matrices and k weights, where k is the number of indicators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regioscope.functions.rsem import nan_to_null, safe_div
from regioscope.session import cut_lineage


def _covariance(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sample covariance matrix in one pass; Spark merges centred moments,
    so nothing cancels however many rows there are."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        value = row[f"c{i}_{j}"]
        cov[i, j] = cov[j, i] = np.nan if value is None else value
    return cov


def _correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(sd, sd)


def _r2_weights(corr: np.ndarray, order: list[int]) -> np.ndarray:
    """1 - R^2 of each indicator on the ones before it (pseudo-inverse,
    clamped to [0, 1]); the first indicator gets weight 1."""
    w = np.ones(len(order))
    for pos in range(1, len(order)):
        j, prev = order[pos], order[:pos]
        s = corr[np.ix_(prev, prev)]
        c = corr[prev, j]
        if np.any(~np.isfinite(s)) or np.any(~np.isfinite(c)):
            r2 = 0.0
        else:
            r2 = float(c @ np.linalg.pinv(s) @ c)
        w[j] = 1.0 - min(1.0, max(0.0, r2))
    return w


def p2_index(df: DataFrame, id_col: str, cols: Sequence[str],
             reference: Callable[[Column], Column] = F.min, max_iter: int = 20,
             out: str = "index"):
    """P2 distance index (Pena 1977).

    ``DP2_i = sum_j |x_ij - x*_j| / sd_j * (1 - R^2_{j | previous})`` where
    x* is the reference vector (``reference`` aggregate per column, column
    minimum by default) and indicators are ordered by the absolute
    correlation of each with the current index.  Starting from the
    unweighted distance, the order is updated until it repeats (a fixed
    point or a cycle) or ``max_iter`` rounds pass.

    Returns ``(index_df, weights_df)``: ``(id, index)`` and one row per
    (iteration, indicator) with position, weight, correlation and ``ended``,
    which says how the iteration came to its end: ``fixed point``, ``cycle``
    or ``limit`` (``max_iter`` rounds without either).
    """
    cols = list(cols)
    ref = df.agg(*[reference(F.col(c)).alias(c) for c in cols]).first()
    dist = df.select(id_col, *[F.abs(F.col(c) - F.lit(ref[c])).alias(c) for c in cols])
    dist = cut_lineage(dist)
    cov = _covariance(dist, cols)
    sd, corr = np.sqrt(np.clip(np.diag(cov), 0, None)), _correlation(cov)
    sd = np.where(sd > 0, sd, np.nan)
    some = np.isfinite(sd)
    weights = np.ones(len(cols))
    rows, seen = [], set()
    order = list(range(len(cols)))
    a, ended = None, "limit"
    for it in range(max_iter + 1):
        # the index is linear in the columns: its correlations follow from
        # their covariances, without another pass over the data
        a = np.where(some, weights / np.where(some, sd, 1.0), 0.0)
        along = np.nan_to_num(cov) @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            r_idx = np.nan_to_num(along / (sd * np.sqrt(max(a @ along, 0.0))), nan=0.0, posinf=0.0, neginf=0.0)
        for pos, j in enumerate(order):
            rows.append((it, cols[j], pos + 1, float(weights[j]), float(r_idx[j])))
        new_order = sorted(range(len(cols)), key=lambda j: (-abs(r_idx[j]), j))
        key = tuple(new_order)
        if it > 0 and (new_order == order or key in seen):
            ended = "fixed point" if new_order == order else "cycle"
            break
        seen.add(key)
        order = new_order
        weights = _r2_weights(corr, order)
    spark = df.sparkSession
    wdf = spark.createDataFrame(rows, "iteration int, indicator string, position int, "
                                      "weight double, corr double").withColumn("ended", F.lit(ended))
    index = sum((F.col(c) * float(a[j]) for j, c in enumerate(cols) if some[j]), F.lit(0.0))
    return dist.select(id_col, index.alias(out)), wdf


def value_positions(df: DataFrame, by: str, order: str, partitions: int | None = None,
                    extra: Sequence[Column] = ()) -> DataFrame:
    """``(by, order, n, before, extra...)``: every distinct value of each
    group, how often it occurs, how many rows of the group are smaller, and
    ``extra`` aggregates of the value's rows.

    Equal values are counted before anything is sorted, so a value that a
    third of all rows share is one row.  The distinct values are
    range-partitioned; a table of (task, group) counts (at most tasks x
    groups rows, joined without a hint) gives every slice its offset.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(by, order).agg(F.count(F.lit(1)).alias("n"), *extra)
    more = counts.columns[3:]
    d = cut_lineage(counts.repartitionByRange(n, by, order).withColumn("_pid", F.spark_partition_id()))
    slices = d.groupBy("_pid", by).agg(F.sum("n").alias("_cnt"))
    w = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    own = Window.partitionBy("_pid", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("_own", F.coalesce(F.sum("n").over(own), F.lit(0)))
            .join(slices.select("_pid", by, "_off"), ["_pid", by])
            .select(by, order, "n", (F.col("_off") + F.col("_own")).alias("before"), *more))


def discrimination(df: DataFrame, cols: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Ivanovic discrimination coefficient per indicator:
    ``2 / (m (m-1)) * sum_{i<l} |x_i - x_l| / |mean|``.

    The pair sum equals ``sum_v n_v (2 before_v + n_v - m) v`` over the distinct
    values v, so only their positions are needed (no self-join).  A mean within ``tol``
    of zero (e.g. z-scores) gives NULL.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("x"))
        for c in cols])).alias("r")).select("r.*").where(F.col("x").isNotNull())
    pos = value_positions(long, "indicator", "x")
    g = pos.groupBy("indicator").agg(F.sum("n").alias("m"),
                                     (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    pair = (pos.join(F.broadcast(g), "indicator")  # one row per indicator
            .groupBy("indicator", "m", "mean")
            .agg(F.sum(F.col("n") * (2 * F.col("before") + F.col("n") - F.col("m")) * F.col("x"))
                 .alias("_pairs")))
    dc = F.when(F.abs("mean") > tol,
                safe_div(2 * F.col("_pairs"), F.col("m") * (F.col("m") - 1) * F.abs("mean")))
    return pair.select("indicator", dc.alias("discrimination"))


def cum_root_f(df: DataFrame, x: str, strata: int, bins: int | str,
               out: str = "stratum") -> DataFrame:
    """Dalenius-Hodges strata: ``bins`` equal-width classes over
    [min, max], cumulative sqrt of class frequencies, boundaries at the
    classes whose cumulative value is nearest to k/L of the total.
    ``bins`` is a number, the same for every table size, or ``"by_rows"``
    for ``min(10 * strata, n)``.  Missing values (NULL, NaN) are not
    counted and get a NULL stratum.  Constant input -> one stratum.  The
    class table has ``bins`` rows; units are joined back to it."""
    value = nan_to_null(F.col(x).cast("double"))
    st = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    lo, hi, n = st["lo"], st["hi"], st["n"]
    if bins == "by_rows":
        bins = max(1, min(10 * strata, n))
    if lo is None or hi == lo:
        return df.withColumn(out, F.when(value.isNotNull(), 1))
    b = F.when(value.isNotNull(),
               F.least(F.floor((value - F.lit(lo)) / F.lit(hi - lo) * bins) + 1, F.lit(bins)))
    d = df.withColumn("_bin", b.cast("int"))
    counts = d.where("_bin is not null").groupBy("_bin").agg(F.count(F.lit(1)).alias("_f"))
    spark = df.sparkSession
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("_bin"))
    # bins table: bounded by the number of classes
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cls = (all_bins.join(counts, "_bin", "left").fillna(0, ["_f"])
           .withColumn("_cum", F.sum(F.sqrt("_f")).over(w)))
    cls = cut_lineage(cls)
    total = cls.select(F.max("_cum")).scalar()
    stratum = F.lit(1)
    for k in range(1, strata):
        target = total * k / strata
        cut_k = cls.orderBy(F.abs(F.col("_cum") - target), "_bin").limit(1).select("_bin").scalar()
        stratum = stratum + (F.col("_bin") > cut_k).cast("int")
    strat = cls.select("_bin", stratum.alias(out))
    return d.join(F.broadcast(strat), "_bin", "left").drop("_bin")


# The five strata labels, highest stratum first.
STRATA_LABELS = ["Very High", "High", "Neutral", "Low", "Very Low"]


def stratum_labels(stratum, labels: Sequence[str] = STRATA_LABELS) -> Column:
    """Label of a stratum: stratum L (the highest) gets ``labels[0]``."""
    s = F.col(stratum) if isinstance(stratum, str) else stratum
    n = len(labels)
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (F.lit(n + 1) - s).cast("int"))
