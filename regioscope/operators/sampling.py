"""Repeatable sampling, splitting and class balancing.

Rows are ordered by ``md5(key || seed)``, a pseudo-random order that does
not depend on partitioning (and that DuckDB reproduces).  Taking "the first
k rows in that order" per group is done without sorting any group inside
one task: a 16-bit prefix histogram (at most 65,536 rows per group) locates
the bucket holding the k-th row, a second 16-bit histogram inside that
bucket narrows it further, and only the remaining handful of rows is
ranked.  The selection is then a filter ``hash <= threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regioscope.session import cut_lineage

_HASH = "_h"


def hash_key(key_cols: Sequence[str], seed) -> F.Column:
    """Row order key: hex md5 of the key columns and the seed."""
    parts = [F.col(c).cast("string") for c in key_cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def _ns_join(left: DataFrame, right: DataFrame, by: Sequence[str], how="inner"):
    if not by:
        # ungrouped: the right side has at most one row -> scalar subqueries
        cols = [c for c in right.columns if c not in left.columns]
        out = left.withColumns({c: right.select(c).scalar() for c in cols})
        if how == "inner":
            out = out.where(F.col(cols[0]).isNotNull())
        return out
    from regioscope.operators.joins import join_keys
    return join_keys(left, right, by, how, null_safe=True)


def _boundary(rows: DataFrame, by: list[str], start: int, need: str) -> DataFrame:
    """Per group, the 16-bit bucket (hex chars start..start+3) that holds
    the ``need``-th row, and how many rows are still needed from it."""
    b = F.substring(_HASH, start, 4)
    counts = rows.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"),
                                                  F.first(need).alias(need))
    w = Window.partitionBy(*by).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_cum", F.sum("_c").over(w))
    return (counts.where((F.col("_cum") - F.col("_c") < F.col(need))
                         & (F.col("_cum") >= F.col(need)))
            .select(*by, F.col("_b").alias(f"_b{start}"),
                    (F.col(need) - (F.col("_cum") - F.col("_c"))).alias(need)))


def sample_first_k(df: DataFrame, size, key_cols: Sequence[str], seed=0,
                   by: Sequence[str] = (), max_groups: int = 1_000_000, copies: bool = False) -> DataFrame:
    """The ``size`` rows of each ``by`` group that come first in hash order.

    ``size`` is an int (same for every group) or a DataFrame
    ``(by..., quota)``; groups without a quota are dropped.  Exact: never
    fewer or more rows than asked (unless the group is smaller).  Where only
    some of the rows of one key fit in, that is an error, or with ``copies``
    those come first whose other columns have the smaller hash.

    Every helper table (totals, boundary buckets, thresholds) has one row
    per group, so a single count of the groups decides whether they are
    broadcast; the first histogram has at most 65,536 rows per group.
    """
    by = list(by)
    d = df.withColumn(_HASH, hash_key(key_cols, seed))
    hist = d.groupBy(*by, F.substring(_HASH, 1, 4).alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"))
    hist = cut_lineage(hist)
    totals = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if isinstance(size, int):
        totals = totals.withColumn("_q", F.lit(size).cast("long"))
    else:
        q = size.select(*by, F.col("quota").cast("long").alias("_q"))
        totals = _ns_join(totals, q, by)
    totals = cut_lineage(totals.where(F.col("_q") > 0))
    small = totals.count() <= max_groups

    def bc(x):
        return F.broadcast(x) if small else x

    short = totals.where(F.col("_n") > F.col("_q")).select(*by, "_q")
    # level 1: 16-bit prefix bucket holding the quota-th row
    w = Window.partitionBy(*by).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h1 = _ns_join(hist, bc(short), by).withColumn("_cum", F.sum("_c").over(w))
    b1 = (h1.where((F.col("_cum") - F.col("_c") < F.col("_q")) & (F.col("_cum") >= F.col("_q")))
          .select(*by, F.col("_b").alias("_b1"),
                  (F.col("_q") - (F.col("_cum") - F.col("_c"))).alias("_q")))
    b1 = cut_lineage(b1)
    # level 2: next 16 bits inside that bucket
    c2 = _ns_join(d.select(*by, _HASH), bc(b1), by) \
        .where(F.substring(_HASH, 1, 4) == F.col("_b1"))
    b2 = _boundary(c2, by, 5, "_q")
    b2 = cut_lineage(b2)
    c3 = _ns_join(c2.drop("_q", "_b1"), bc(b2), by) \
        .where(F.substring(_HASH, 5, 4) == F.col("_b5"))
    # what remains is ~ rows / 2^32 keys per group, each with its copies
    c3 = c3.groupBy(*by, _HASH).agg(F.count(F.lit(1)).alias("_c"), F.first("_q").alias("_q"))
    wr = Window.partitionBy(*by).orderBy(_HASH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.col("_cum") - F.col("_q")
    thr = (c3.withColumn("_cum", F.sum("_c").over(wr))
           .where((over >= 0) & (over < F.col("_c")))
           .select(*by, F.col(_HASH).alias("_t"), F.col("_c").alias("_k"), (F.col("_c") - over).alias("_m")))
    thr = cut_lineage(thr)
    cut = thr.where("_m < _k")
    some = cut.limit(1).count() > 0
    if some and not copies:
        raise ValueError(f"{list(key_cols)} does not identify the rows of a group: "
                         "give key columns that do")
    keep = _ns_join(totals.select(*by, "_n", "_q"), thr, by, "left")
    keep = cut_lineage(keep)
    out = _ns_join(d, bc(keep), by) \
        .where((F.col("_n") <= F.col("_q")) | (F.col(_HASH) < F.col("_t"))
               | ((F.col(_HASH) == F.col("_t")) & (F.col("_m") == F.col("_k"))))
    out = out.drop(_HASH, "_q", "_n", "_t", "_k", "_m")
    return out.unionByName(_first_copies(d, bc(cut), by, df.columns)) if some else out


def _first_copies(rows: DataFrame, cut: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of each group's boundary key ``_t`` the first ``_m`` in the
    order of a hash of all columns; equal rows are counted, not ranked."""
    at = _ns_join(rows, cut, by).where(F.col(_HASH) == F.col("_t"))
    at = at.groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"), F.first("_m").alias("_m"))
    w = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("_x", F.xxhash64(*columns)).withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    take = F.least(F.col("_c"), F.col("_m") - F.col("_before"))
    at = at.where("_before < _m").withColumn("_x", F.explode(F.sequence(F.lit(1).cast("long"), take)))
    return at.select(*columns)


def downsample(df: DataFrame, label: str, key_cols: Sequence[str], seed=0,
               by: Sequence[str] = ()) -> DataFrame:
    """Class balancing: every class of a group cut to the group's minority
    size (the minority itself is kept whole).  Groups with a single class
    cannot be balanced and are dropped.  Keys may repeat."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    minority = counts.groupBy(*by).agg(F.min("_n").alias("quota"),
                                       F.count(F.lit(1)).alias("_k")) \
        .where(F.col("_k") > 1).drop("_k")
    quota = _ns_join(counts.select(*by, label), minority, by) \
        .select(*by, label, "quota")
    return sample_first_k(df, quota, key_cols, seed, by=by + [label], copies=True)


def _hex_bound(frac: float) -> str:
    return format(min(int(round(frac * 16 ** 8)), 16 ** 8 - 1), "08x") \
        if frac < 1 else "g"


def hash_split(df: DataFrame, weights: Sequence[float], key_cols: Sequence[str],
               seed=0) -> list[DataFrame]:
    """Deterministic split by keyed hash: ``[train, test, ...]``.

    Row r goes to part i when the first 32 bits of its hash fall in the
    i-th slice of the normalised weights; independent of partitioning.
    """
    total = float(sum(weights))
    d = df.withColumn(_HASH, F.substring(hash_key(key_cols, seed), 1, 8))
    parts, lo = [], 0.0
    for i, w in enumerate(weights):
        hi = lo + w / total
        lo_s, hi_s = _hex_bound(lo), _hex_bound(hi) if i < len(weights) - 1 else "g"
        parts.append(d.where((F.col(_HASH) >= lo_s) & (F.col(_HASH) < hi_s))
                     .drop(_HASH))
        lo = hi
    return parts
