"""Product C: neighbourhood quality, cohort potential, period series.

Plan shape at scale: lineitem is partially aggregated by order key (the
join key), so the orders join reuses that hash partitioning; per-order
rows are pre-aggregated again by (customer, priority) before the customer
join; everything after that is small.  No window sorts a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioscope.operators import aggregates as A
from regioscope.operators import windows as W
from regioscope.plans.bindings import load, r6, scored_lines
from regioscope.plans.registry import R6, query

# -- shared building blocks -------------------------------------------------

_SCORED_SQL = "(SELECT l_orderkey, abs(l_discount) * 10.0 AS q FROM lineitem)"


def order_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order (neighbourhood): mean score, sd, row count, repaired.

    An order without lines is an empty neighbourhood: one row of NAs in the
    joined table, so its mean is missing, and the repair sets n = 0, q = 0.
    """
    per_order = A.group_stats(scored_lines(spark, sf_dir), ["l_orderkey"], "q")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                             "o_orderpriority", "o_orderdate")
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left") \
        .drop("l_orderkey").withColumn("n", F.coalesce("n", F.lit(1)))
    return A.cohort_potential(j)


_NEIGHBOURHOOD_SQL = f"""
WITH s AS (
  SELECT o_orderkey, o_custkey, o_orderpriority,
         CASE WHEN count(q) = count(*) THEN avg(q) END AS qi,
         CASE WHEN count(q) = count(*) THEN stddev_samp(q) END AS sd,
         count(*) AS n0
  FROM orders LEFT JOIN {_SCORED_SQL} l ON o_orderkey = l_orderkey
  GROUP BY o_orderkey, o_custkey, o_orderpriority),
nb AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, coalesce(qi, 0) AS qi, sd,
         CASE WHEN qi IS NULL THEN 0 ELSE n0 END AS n
  FROM s)
"""


@query("a1_neighbourhood_stats", sql=_NEIGHBOURHOOD_SQL + f"""
SELECT o_orderkey, {R6('qi')} AS quality_index, {R6('sd')} AS std_dev,
       CAST(n AS BIGINT) AS n, {R6('n * qi')} AS cohort_potential
FROM nb
""")
def a1_neighbourhood_stats(spark, sf_dir):
    nb = order_neighbourhoods(spark, sf_dir)
    return nb.select("o_orderkey", r6("quality_index").alias("quality_index"),
                     r6("std_dev").alias("std_dev"), F.col("n").cast("long").alias("n"),
                     r6("cohort_potential").alias("cohort_potential"))


def municipality_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhoods rolled up to (nation, priority): weighted quality,
    total businesses, cohort potential."""
    nb = order_neighbourhoods(spark, sf_dir)
    # pre-aggregate per (customer, priority) before joining the customers
    pre = nb.groupBy("o_custkey", "o_orderpriority").agg(
        F.sum(F.col("quality_index") * F.col("n")).alias("_qn"),
        F.sum("n").alias("_n"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    mun = (pre.join(c, pre.o_custkey == c.c_custkey)
           .groupBy("c_nationkey", "o_orderpriority")
           # the weighted sum is canonicalised to 1e-9 so that the quotient
           # does not depend on summation order
           .agg(F.try_divide(F.round(F.sum("_qn"), 9), F.sum("_n")).alias("quality_index"),
                F.sum("_n").alias("total"))
           .withColumn("quality_index", F.coalesce("quality_index", F.lit(0.0)))
           .withColumn("cohort_potential", F.col("quality_index") * F.col("total")))
    # nation: 25 rows at every scale factor
    n = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return mun.join(n, mun.c_nationkey == n.n_nationkey).drop("n_nationkey")


_MUNICIPALITY_SQL = _NEIGHBOURHOOD_SQL + """,
mun AS (
  SELECT n_name, o_orderpriority,
         coalesce(round(sum(qi * n), 9) / nullif(sum(n), 0), 0) AS qi, sum(n) AS total
  FROM nb JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, o_orderpriority)
"""


@query("cohort_top30", sql=_MUNICIPALITY_SQL + f"""
SELECT n_name, o_orderpriority, {R6('qi')} AS quality_index,
       CAST(total AS BIGINT) AS total, {R6('qi * total')} AS cohort_potential
FROM mun
WHERE qi * total >= (SELECT min(c) FROM
                     (SELECT qi * total AS c FROM mun ORDER BY c DESC LIMIT 30))
""")
def cohort_top30(spark, sf_dir):
    """Flagship: top 30 municipalities by cohort potential (ties kept)."""
    mun = municipality_cohorts(spark, sf_dir)
    top = W.top_n_with_ties(mun, 30, "cohort_potential")
    return top.select("n_name", "o_orderpriority",
                      r6("quality_index").alias("quality_index"),
                      F.col("total").cast("long").alias("total"),
                      r6("cohort_potential").alias("cohort_potential"))


# -- period series (A2-A4, W1) ----------------------------------------------

def period_neighbourhood_eqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: per (period, nation, priority): mean score skipping NA, and the
    row count including unscored (empty) orders."""
    li = scored_lines(spark, sf_dir)
    per_order = li.groupBy("l_orderkey").agg(F.sum("q").alias("_sq"),
                                             F.count("q").alias("_cq"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
         .withColumn("_rows", F.coalesce("_cq", F.lit(1)))
         .withColumn("period", F.trunc(F.col("o_orderdate").cast("date"), "month"))
         .groupBy("o_custkey", "period")
         .agg(F.sum("_sq").alias("_sq"), F.sum("_cq").alias("_cq"),
              F.sum("_rows").alias("_rows")))
    return (j.join(c, j.o_custkey == c.c_custkey)
            .groupBy("period", "c_nationkey")
            .agg(F.try_divide(F.sum("_sq"), F.sum("_cq")).alias("eqi"),
                 F.sum("_rows").alias("n")))


_PERIOD_SQL = f"""
WITH eq AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, c_nationkey,
         avg(q) AS eqi, count(*) AS n
  FROM orders LEFT JOIN {_SCORED_SQL} l ON o_orderkey = l_orderkey
       JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2)
"""


@query("a2_period_eqi", sql=_PERIOD_SQL + f"""
SELECT period, c_nationkey, {R6('eqi')} AS eqi, CAST(n AS BIGINT) AS n FROM eq
""")
def a2_period_eqi(spark, sf_dir):
    e = period_neighbourhood_eqi(spark, sf_dir)
    return e.select("period", "c_nationkey", r6("eqi").alias("eqi"),
                    F.col("n").cast("long").alias("n"))


@query("a3_period_rollup", sql=_PERIOD_SQL + f"""
SELECT period,
       {R6('CASE WHEN count(eqi) = count(*) THEN avg(eqi) END')} AS eqi,
       {R6('CASE WHEN count(eqi) = count(*) THEN stddev_samp(eqi) END')} AS std,
       CAST(sum(n) AS BIGINT) AS n
FROM eq WHERE c_nationkey IS NOT NULL GROUP BY period
""")
def a3_period_rollup(spark, sf_dir):
    e = period_neighbourhood_eqi(spark, sf_dir).where(F.col("c_nationkey").isNotNull())
    r = A.period_rollup(e, ["period"])
    return r.select("period", r6("eqi").alias("eqi"), r6("std").alias("std"),
                    F.col("n").cast("long").alias("n"))


@query("w1_base_index", sql=_PERIOD_SQL + f"""
, g AS (
  SELECT period, r_name,
         CASE WHEN count(eqi) = count(*) THEN avg(eqi) END AS eqi,
         CASE WHEN count(eqi) = count(*) THEN stddev_samp(eqi) END AS std,
         sum(n) AS n
  FROM eq JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey
  GROUP BY period, r_name)
SELECT period, r_name, {R6('eqi')} AS eqi, {R6('std')} AS std,
       CAST(n AS BIGINT) AS n,
       {R6('100 * eqi / nullif(first_value(eqi) OVER (PARTITION BY r_name ORDER BY period), 0)')}
         AS "index"
FROM g
""")
def w1_base_index(spark, sf_dir):
    """A4 + W1: region (borough) x period roll-up, then the base-period
    index ``100 * EQI / first(EQI)`` per region."""
    e = period_neighbourhood_eqi(spark, sf_dir)
    n = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = F.broadcast(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    e = (e.join(n, e.c_nationkey == n.n_nationkey)
         .join(r, F.col("n_regionkey") == r.r_regionkey))
    g = A.period_rollup(e, ["period", "r_name"])
    idx = W.base_index(g, "eqi", ["r_name"], "period", out="index")
    return idx.select("period", "r_name", r6("eqi").alias("eqi"), r6("std").alias("std"),
                      F.col("n").cast("long").alias("n"), r6("index").alias("index"))


# -- counts, shares, top-n (A8, W2, W3) ---------------------------------------

def _order_counts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority",
                                             "o_orderstatus")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey",
                                               "c_mktsegment")
    # pre-aggregate orders per (customer, priority, status) before the join
    pre = o.groupBy("o_custkey", "o_orderpriority", "o_orderstatus") \
        .agg(F.count(F.lit(1)).alias("_n"))
    return (pre.join(c, pre.o_custkey == c.c_custkey)
            .groupBy("c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderstatus")
            .agg(F.sum("_n").alias("n")))


_COUNTS_SQL = """
WITH cnt AS (
  SELECT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3, 4)
"""


@query("a8_group_count", sql=_COUNTS_SQL + """
SELECT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus,
       CAST(n AS BIGINT) AS n FROM cnt
""")
def a8_group_count(spark, sf_dir):
    return _order_counts(spark, sf_dir).withColumn("n", F.col("n").cast("long"))


@query("w2_share_within", sql=_COUNTS_SQL + f"""
SELECT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus,
       CAST(n AS BIGINT) AS n,
       {R6('n / sum(n) OVER (PARTITION BY c_nationkey, c_mktsegment, o_orderpriority)')}
         AS percentage
FROM cnt
""")
def w2_share_within(spark, sf_dir):
    s = W.share_within(_order_counts(spark, sf_dir), "n",
                       ["c_nationkey", "c_mktsegment", "o_orderpriority"])
    return s.select("c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderstatus",
                    F.col("n").cast("long").alias("n"), r6("percentage").alias("percentage"))


@query("w3_top_n_ties", sql="""
WITH c AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(n_orders AS BIGINT) AS n_orders FROM c
WHERE n_orders >= (SELECT min(n_orders) FROM
                   (SELECT n_orders FROM c ORDER BY n_orders DESC LIMIT 30))
""")
def w3_top_n_ties(spark, sf_dir):
    """Top 30 customers by order count; ties at the boundary are kept."""
    o = load(spark, sf_dir, "orders")
    c = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return W.top_n_with_ties(c, 30, "n_orders")
