"""Table-level operators: joins, sampling, splitting, unions, profiles,
correlation, z-scores, JSON payloads (S, J, O, U, A7-A12, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regioscope.functions.rsem import numeric_columns, safe_div
from regioscope.operators import aggregates as A
from regioscope.operators import joins as J
from regioscope.operators import sampling as S
from regioscope.operators import windows as W
from regioscope.plans.bindings import (INDICATOR_COLS, indicators, load, r6,
                                       region_product, registry)
from regioscope.plans.establishments import REGISTRY_SQL
from regioscope.plans.registry import R6, query

# -- joins --------------------------------------------------------------------


@query("j1_inner_differing_keys", sql="""
SELECT n_name AS entidad, n_regionkey, CAST(suppliers AS BIGINT) AS suppliers
FROM nation JOIN (SELECT n2.n_name AS state, count(*) AS suppliers
                  FROM supplier JOIN nation n2 ON s_nationkey = n2.n_nationkey
                  GROUP BY 1) s ON n_name = state
""")
def j1_inner_differing_keys(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    s = load(spark, sf_dir, "supplier")
    sup = (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
           .groupBy(F.col("n_name").alias("state"))
           .agg(F.count(F.lit(1)).alias("suppliers")))
    left = n.select(F.col("n_name").alias("entidad"), "n_regionkey")
    return J.join_keys(left, sup, [("entidad", "state")], "inner")


@query("j4_left_catalogue", sql=f"""
SELECT p_partkey, p_name, {R6('sales')} AS sales, CAST(lines AS BIGINT) AS lines
FROM part LEFT JOIN (SELECT l_partkey, sum(abs(l_discount) * 10.0) AS sales,
                            count(*) AS lines
                     FROM lineitem GROUP BY 1) l ON p_partkey = l_partkey
""")
def j4_left_catalogue(spark, sf_dir):
    """Catalogue left join: every part, with its aggregated sales or NULL."""
    li = load(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey").agg(
        F.sum(F.abs("l_discount") * 10.0).alias("sales"),
        F.count(F.lit(1)).alias("lines"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    out = J.join_keys(p, per_part, [("p_partkey", "l_partkey")], "left")
    return out.withColumn("sales", r6("sales"))


_KEYS5 = ["tipo_vial", "tipo_asent", "cve_ent", "cve_mun", "tipoUniEco"]


@query("j5_null_safe_left", sql="WITH " + REGISTRY_SQL + """
, g AS (SELECT tipo_vial, tipo_asent, cve_ent, cve_mun, "tipoUniEco", count(*) AS group_n
        FROM registry GROUP BY ALL)
SELECT r.id, r.tipo_vial, r.tipo_asent, CAST(g.group_n AS BIGINT) AS group_n
FROM registry r LEFT JOIN g
  ON r.tipo_vial IS NOT DISTINCT FROM g.tipo_vial
 AND r.tipo_asent IS NOT DISTINCT FROM g.tipo_asent
 AND r.cve_ent IS NOT DISTINCT FROM g.cve_ent
 AND r.cve_mun IS NOT DISTINCT FROM g.cve_mun
 AND r."tipoUniEco" IS NOT DISTINCT FROM g."tipoUniEco"
""")
def j5_null_safe_left(spark, sf_dir):
    """Left join on five keys where NA matches NA (dplyr semantics)."""
    reg = registry(spark, sf_dir)
    g = reg.groupBy(*_KEYS5).agg(F.count(F.lit(1)).alias("group_n"))
    out = J.join_keys(reg.select("id", *_KEYS5), g, _KEYS5, "left", null_safe=True)
    return out.select("id", "tipo_vial", "tipo_asent", "group_n")


@query("j6_natural_left", sql="WITH " + REGISTRY_SQL + f"""
, g AS (SELECT tipo_vial, tipo_asent, avg(latitud) AS mean_lat FROM registry GROUP BY ALL)
SELECT r.id, r.tipo_vial, r.tipo_asent, {R6('g.mean_lat')} AS mean_lat
FROM registry r LEFT JOIN g
  ON r.tipo_vial IS NOT DISTINCT FROM g.tipo_vial
 AND r.tipo_asent IS NOT DISTINCT FROM g.tipo_asent
""")
def j6_natural_left(spark, sf_dir):
    """Natural left join on all shared column names (NA matches NA)."""
    reg = registry(spark, sf_dir)
    g = reg.groupBy("tipo_vial", "tipo_asent").agg(F.avg("latitud").alias("mean_lat"))
    out = J.natural_join(reg.select("id", "tipo_vial", "tipo_asent"), g, "left")
    return out.withColumn("mean_lat", r6("mean_lat"))


# DuckDB twin of bindings.indicators
INDICATORS_SQL = f"""
ind AS (
  SELECT n_nationkey, n_name AS entidad,
    {", ".join(f"coalesce({c}, 0) AS {c}" for c in INDICATOR_COLS)}
  FROM nation
  LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS customers,
                    avg(c_acctbal) AS mean_acctbal,
                    avg(CAST(c_acctbal < 0 AS DOUBLE)) AS share_negative,
                    avg(CAST(c_mktsegment = 'BUILDING' AS DOUBLE)) AS share_building
             FROM customer GROUP BY 1) c ON n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT c_nationkey, avg(o_totalprice) AS mean_order,
                    avg(CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) AS share_urgent,
                    CAST(count(*) AS DOUBLE) AS orders
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o
         ON n_nationkey = o.c_nationkey
  LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS suppliers,
                    sum(s_acctbal) AS supplier_acctbal
             FROM supplier GROUP BY 1) s ON n_nationkey = s.s_nationkey)
"""


@query("j10_scalar_broadcast", sql="WITH " + INDICATORS_SQL + f"""
SELECT entidad, {R6('mean_order')} AS mean_order,
       {R6('avg(mean_order) OVER ()')} AS overall_mean_order
FROM ind
""")
def j10_scalar_broadcast(spark, sf_dir):
    """A whole-table mean attached to every row (reference line)."""
    ind = indicators(spark, sf_dir)
    out = J.with_global(ind, F.avg("mean_order"), "overall_mean_order")
    return out.select("entidad", r6("mean_order").alias("mean_order"),
                      r6("overall_mean_order").alias("overall_mean_order"))


# -- sorting, sampling, splitting, balancing ----------------------------------

@query("o2_head_ranked", sql="""
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200
""")
def o2_head_ranked(spark, sf_dir):
    """``head(200)`` in rank order: a distributed take-ordered."""
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_acctbal") \
        .orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(200)


_LINE_HASH = ("md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), "
              "CAST(l_linenumber AS VARCHAR), '123'))")


@query("o4_sample_n", sql=f"""
SELECT l_orderkey, l_linenumber FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {_LINE_HASH}) AS rn
  FROM lineitem WHERE l_returnflag <> 'A') WHERE rn <= 17174
""")
def o4_sample_n(spark, sf_dir):
    """Exact-size repeatable sample (17,174 rows of the negative class)."""
    li = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "A") \
        .select("l_orderkey", "l_linenumber")
    return S.sample_first_k(li, 17174, ["l_orderkey", "l_linenumber"], seed=123, copies=True)


@query("o5_hash_split", sql=f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN substr({_LINE_HASH}, 1, 8) < 'c0000000' THEN 'training' ELSE 'test' END
         AS part
FROM lineitem
""")
def o5_hash_split(spark, sf_dir):
    """0.75 / 0.25 split with seed 123, independent of partitioning."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    tr, te = S.hash_split(li, [0.75, 0.25], ["l_orderkey", "l_linenumber"], seed=123)
    return J.union_all([tr.withColumn("part", F.lit("training")),
                        te.withColumn("part", F.lit("test"))])


@query("m12_downsample", sql=f"""
WITH t AS (SELECT l_orderkey, l_linenumber,
                  CAST(l_returnflag = 'A' AS DOUBLE) AS y FROM lineitem),
m AS (SELECT min(n) AS q FROM (SELECT y, count(*) AS n FROM t GROUP BY y))
SELECT l_orderkey, l_linenumber, y FROM (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_LINE_HASH}) AS rn FROM t)
WHERE rn <= (SELECT q FROM m)
""")
def m12_downsample(spark, sf_dir):
    """Class balancing + union: all of the minority, an equal-size hash
    sample of the majority."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "A").cast("double").alias("y"))
    return S.downsample(li, "y", ["l_orderkey", "l_linenumber"], seed=123)


@query("u2_union_by_name", sql="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'
UNION ALL BY NAME
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'
""")
def u2_union_by_name(spark, sf_dir):
    """Union of drifting schemas; missing columns are NULL-filled."""
    o = load(spark, sf_dir, "orders")
    return J.union_all([
        o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"),
        o.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderdate"),
        o.where(F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderpriority")])


# -- region x product sums, distinct -------------------------------------------

RP_SQL = """
rp AS (SELECT n_name || ', ' || r_name AS country, p_name AS product,
              sum(l_extendedprice) AS value
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                     JOIN part ON l_partkey = p_partkey
                     JOIN nation ON s_nationkey = n_nationkey
                     JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1, 2)
"""


@query("a7_value_by_country", sql="WITH " + RP_SQL + f"""
SELECT country AS name, {R6('sum(value)')} AS gross_value_added FROM rp GROUP BY 1
""")
def a7_value_by_country(spark, sf_dir):
    out = A.sum_by(region_product(spark, sf_dir), "country")
    return out.withColumn("gross_value_added", r6("gross_value_added"))


@query("a7_value_by_product", sql="WITH " + RP_SQL + f"""
SELECT product AS name, {R6('sum(value)')} AS gross_value_added FROM rp GROUP BY 1
""")
def a7_value_by_product(spark, sf_dir):
    out = A.sum_by(region_product(spark, sf_dir), "product")
    return out.withColumn("gross_value_added", r6("gross_value_added"))


@query("a10_distinct_presence", sql="""
SELECT DISTINCT s_nationkey, p_brand
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
""")
def a10_distinct_presence(spark, sf_dir):
    """Distinct (supplier nation, brand) pairs; the distinct is partial
    (map-side) before the shuffle."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pre = li.join(J.broadcast_if_small(s), li.l_suppkey == s.s_suppkey) \
        .select("s_nationkey", "l_partkey").dropDuplicates()
    return pre.join(p, pre.l_partkey == p.p_partkey) \
        .select("s_nationkey", "p_brand").dropDuplicates()


# -- indicator-table statistics --------------------------------------------------

def _corr_sql():
    arms = []
    for a in INDICATOR_COLS:
        for b in INDICATOR_COLS:
            arms.append(
                f"SELECT '{a}' AS var1, '{b}' AS var2, "
                f"{R6(f'covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)')}"
                f" AS corr FROM ind")
    return "WITH " + INDICATORS_SQL + "\n" + "\nUNION ALL\n".join(arms)


@query("a11_correlation", sql=_corr_sql())
def a11_correlation(spark, sf_dir):
    """Correlation matrix of all indicators as a long table."""
    c = A.correlation_long(indicators(spark, sf_dir), INDICATOR_COLS)
    return c.withColumn("corr", r6("corr"))


def _profile_sql():
    arms = []
    for c in INDICATOR_COLS:
        arms.append(
            f"SELECT '{c}' AS \"column\", count(*) AS n, "
            f"count(*) - count({c}) AS n_missing, {R6(f'avg({c})')} AS mean, "
            f"{R6(f'stddev_samp({c})')} AS sd, {R6(f'min({c})')} AS min, "
            f"{R6(f'quantile_cont({c}, 0.25)')} AS q1, "
            f"{R6(f'quantile_cont({c}, 0.5)')} AS median, "
            f"{R6(f'quantile_cont({c}, 0.75)')} AS q3, {R6(f'max({c})')} AS max FROM ind")
    return "WITH " + INDICATORS_SQL + "\n" + "\nUNION ALL\n".join(arms)


@query("a12_profile", sql=_profile_sql())
def a12_profile(spark, sf_dir):
    """Column profile with exact R-type-7 quartiles (bounded input)."""
    ind = indicators(spark, sf_dir)
    # select_if(is.numeric): every numeric column but the key
    cols = [c for c in numeric_columns(ind) if c != "n_nationkey"]
    p = A.profile(ind, cols)
    return p.select("column", F.col("n").cast("long"), F.col("n_missing").cast("long"),
                    *[r6(c).alias(c) for c in ["mean", "sd", "min", "q1", "median",
                                                "q3", "max"]])


@query("w4_zscore", sql="WITH " + INDICATORS_SQL + "\nSELECT entidad, " + ", ".join(
    f"{R6(f'({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)')} AS {c}"
    for c in INDICATOR_COLS) + " FROM ind")
def w4_zscore(spark, sf_dir):
    """``scale()``: every indicator centred and divided by its sample sd."""
    z = W.zscore(indicators(spark, sf_dir), INDICATOR_COLS)
    return z.select("entidad", *[r6(c).alias(c) for c in INDICATOR_COLS])


# -- JSON payload ----------------------------------------------------------------

@query("s7_json_payload", sql=f"""
SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k,
       {R6('avg(value)')} AS mean_value
FROM events GROUP BY event_type
""")
def s7_json_payload(spark, sf_dir):
    """JSON payload column parsed with a declared schema, then grouped."""
    ev = load(spark, sf_dir, "events")
    k = F.from_json("props", "k BIGINT")["k"]
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(k).cast("long").alias("sum_k"),
                                        r6(F.avg("value")).alias("mean_value"))
