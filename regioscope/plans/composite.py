"""Product A: standardised indicators -> P2 index -> strata -> validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from regioscope.functions import text as X
from regioscope.functions.rsem import cast_all
from regioscope.operators import aggregates as A
from regioscope.operators import complexity as C
from regioscope.operators import composite as P
from regioscope.operators import joins as J
from regioscope.operators import windows as W
from regioscope.plans.bindings import INDICATOR_COLS, indicators, load, r6, region_product
from regioscope.plans.complexity import ECI_SQL
from regioscope.plans.registry import R6, query
from regioscope.plans.tables import INDICATORS_SQL


def _zmatrix(spark, sf_dir):
    """Indicator matrix, cast and z-scored (sample sd)."""
    # mutate_all(as.numeric) then scale()
    return W.zscore(cast_all(indicators(spark, sf_dir), INDICATOR_COLS), INDICATOR_COLS)


_Z_SQL = "WITH " + INDICATORS_SQL + ", z AS (SELECT entidad, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}"
    for c in INDICATOR_COLS) + " FROM ind)"


@query("c2_reference_vector", sql=_Z_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS indicator, {R6(f'min({c})')} AS reference FROM z" for c in INDICATOR_COLS))
def c2_reference_vector(spark, sf_dir):
    """Reference vector of the P2 distance: column minimum of the
    standardised matrix, as a long table."""
    z = _zmatrix(spark, sf_dir)
    row = z.agg(*[F.struct(F.lit(c).alias("indicator"), F.min(c).alias("reference"))
                  for c in INDICATOR_COLS])
    return row.select(F.inline(F.array(*[F.col(c) for c in row.columns]))) \
        .withColumn("reference", r6("reference"))


def icap(spark, sf_dir):
    z = _zmatrix(spark, sf_dir)
    return P.p2_index(z, "entidad", INDICATOR_COLS, reference=F.min, out="icap_index")


def _strata_ctes(source: str, id_col: str, x: str, bins: int = 50, strata: int = 5) -> str:
    """CTEs up to ``s``: (id, stratum) of the rows of ``source``."""
    cuts = ", ".join(
        f"(SELECT bin FROM cls ORDER BY abs(cum - (SELECT max(cum) FROM cls) * {k} / {strata}), bin "
        f"LIMIT 1) AS c{k}" for k in range(1, strata))
    strat = " + ".join(f"CAST(bin > c{k} AS INTEGER)" for k in range(1, strata))
    return f"""
st AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {source}),
d AS (SELECT {id_col},
             CASE WHEN {x} IS NOT NULL THEN CAST(least(floor(({x} - lo) / (hi - lo) * {bins}) + 1, {bins}) AS INTEGER) END AS bin
      FROM {source}, st),
cnt AS (SELECT bin, count(*) AS f FROM d WHERE bin IS NOT NULL GROUP BY bin),
cls AS (SELECT r.bin, sum(sqrt(coalesce(f, 0))) OVER (ORDER BY r.bin
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})) r
        LEFT JOIN cnt ON r.bin = cnt.bin),
cuts AS (SELECT {cuts}),
s AS (SELECT {id_col}, 1 + {strat} AS stratum FROM d, cuts)"""


def _label_sql(strata: int = 5) -> str:
    labels = "[" + ", ".join(f"'{v}'" for v in P.STRATA_LABELS) + "]"
    return f"{labels}[{strata + 1} - stratum]"


def _p2_ctes(max_iter: int = 20) -> str:
    """CTEs of the P2 index: ``dist`` (long), ``cov``, ``p2`` (one row per
    iteration: order ``ord``, weights ``w``, correlations ``r`` and whether it
    ``stop``s) and ``idx`` (entidad, icap_index).

    The weight of the s-th indicator is the s-th diagonal element of the
    correlation matrix, in the iteration's order, after the s - 1 elimination
    steps before it (LDL): the share of its variance that those before it
    leave.
    """
    k = len(INDICATOR_COLS)
    lst = f"range(1, {k + 1})"

    def each(var: str, body: str) -> str:
        return f"list_transform({lst}, lambda {var}: {body})"

    def measure(rows: str) -> str:
        """r, the next order and the end of the iteration for rows (it, ord, w, seen)."""
        a = f"SELECT *, {each('i', 'w[i] / sqrt(v[i][i])')} AS a FROM ({rows}), covm"
        along = f"SELECT *, {each('i', f'list_sum({each("j", "v[i][j] * a[j]")})')} AS al FROM ({a})"
        r = f"SELECT *, {each('i', f'al[i] / (sqrt(v[i][i]) * sqrt(list_sum({each("j", "a[j] * al[j]")})))')} AS r FROM ({along})"
        new = (f"SELECT *, list_transform(list_sort({each('i', '{{a: -abs(r[i]), j: i}}')}), lambda x: x.j) AS new "
               f"FROM ({r})").replace("{{", "{").replace("}}", "}")
        return (f"SELECT it, ord, w, r, new, seen, it > 0 AND list_contains(seen, new) AS stop, "
                f"it > 0 AND new = ord AS fixed FROM ({new})")

    steps = (f"SELECT it + 1 AS it, new AS ord, list_append(seen, new) AS seen, v, "
             f"{each('i', each('j', 'v[new[i]][new[j]] / sqrt(v[new[i]][new[i]] * v[new[j]][new[j]])'))} AS m1 "
             f"FROM p2, covm WHERE NOT stop AND it < {max_iter}")
    for s in range(1, k):
        steps = (f"SELECT *, {each('i', each('j', f'm{s}[i][j] - m{s}[i][{s}] * m{s}[{s}][j] / m{s}[{s}][{s}]'))} AS m{s + 1} "
                 f"FROM ({steps})")
    pivots = ", ".join(f"least(1.0, greatest(0.0, m{s}[{s}][{s}]))" for s in range(1, k + 1))
    weights = f"SELECT it, ord, seen, [{pivots}] AS piv FROM ({steps})"
    weights = f"SELECT it, ord, {each('j', 'piv[list_position(ord, j)]')} AS w, seen FROM ({weights})"
    start = (f"SELECT 0 AS it, CAST({lst} AS BIGINT[]) AS ord, {each('i', 'CAST(1 AS DOUBLE)')} AS w, "
             "CAST([] AS BIGINT[][]) AS seen")
    dist = " UNION ALL ".join(f"SELECT entidad, {j + 1} AS j, abs({c} - (SELECT min({c}) FROM z)) AS d FROM z"
                              for j, c in enumerate(INDICATOR_COLS))
    return f"""
dist AS MATERIALIZED ({dist}),
cov AS (SELECT a.j AS i, b.j AS j, covar_samp(a.d, b.d) AS v FROM dist a JOIN dist b USING (entidad) GROUP BY 1, 2),
covm AS MATERIALIZED (SELECT list(vs ORDER BY i) AS v FROM (SELECT i, list(v ORDER BY j) AS vs FROM cov GROUP BY i)),
p2 AS (
  {measure(start)}
  UNION ALL
  {measure(weights)}),
fin AS (SELECT * FROM p2 ORDER BY it DESC LIMIT 1),
idx AS MATERIALIZED (SELECT entidad, sum(d * w[j] / sqrt(v[j][j])) AS icap_index FROM dist, fin, covm GROUP BY 1)"""


_P2_SQL = _Z_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _p2_ctes()


@query("c3_p2_index", sql=_P2_SQL + "," + _strata_ctes("idx", "entidad", "icap_index") + f"""
SELECT entidad, {R6('icap_index')} AS icap_index, CAST(stratum AS INTEGER) AS stratum, {_label_sql()} AS icap_strata
FROM idx JOIN s USING (entidad)
""")
def c3_p2_index(spark, sf_dir):
    """Innovation-capacity index per nation with its stratum and label
    (P2 distance, C3 + C6 + C7)."""
    idx, _ = icap(spark, sf_dir)
    st = P.cum_root_f(idx, "icap_index", strata=5, bins=50)
    return st.select("entidad", r6("icap_index").alias("icap_index"),
                     F.col("stratum").cast("int").alias("stratum"),
                     P.stratum_labels("stratum").alias("icap_strata"))


@query("c5_index_correlation", sql=_P2_SQL + f"""
SELECT CAST(it AS INTEGER) AS iteration, [{', '.join(f"'{c}'" for c in INDICATOR_COLS)}][j] AS indicator,
       CAST(list_position(ord, j) AS INTEGER) AS position, {R6('w[j]')} AS weight, {R6('r[j]')} AS corr,
       (SELECT CASE WHEN fixed THEN 'fixed point' WHEN stop THEN 'cycle' ELSE 'limit' END FROM fin) AS ended
FROM p2, range(1, {len(INDICATOR_COLS) + 1}) t(j)
""")
def c5_index_correlation(spark, sf_dir):
    """Per iteration and indicator: order position, P2 weight, and the
    correlation of the indicator with that iteration's index."""
    _, w = icap(spark, sf_dir)
    return w.withColumn("weight", r6("weight")).withColumn("corr", r6("corr"))


_LONG_SQL = "WITH " + INDICATORS_SQL + ", long AS (" + " UNION ALL ".join(
    f"SELECT entidad, '{c}' AS indicator, {c} AS x FROM ind" for c in INDICATOR_COLS) + ")"


@query("c4_discrimination", sql=_LONG_SQL + f"""
, pairs AS (SELECT a.indicator, sum(abs(a.x - b.x)) AS s
            FROM long a JOIN long b ON a.indicator = b.indicator AND a.entidad < b.entidad
            GROUP BY 1),
g AS (SELECT indicator, count(*) AS m, avg(x) AS mean FROM long GROUP BY 1)
SELECT indicator,
       {R6('CASE WHEN abs(mean) > 1e-9 THEN 2 * s / (m * (m - 1) * abs(mean)) END')}
         AS discrimination
FROM g JOIN pairs USING (indicator)
""")
def c4_discrimination(spark, sf_dir):
    """Discrimination coefficient of every raw indicator."""
    d = P.discrimination(indicators(spark, sf_dir), INDICATOR_COLS)
    return d.withColumn("discrimination", r6("discrimination"))


@query("c6_strata", sql="WITH " + _strata_ctes("customer", "c_custkey", "c_acctbal") + f"""
SELECT c_custkey, CAST(stratum AS INTEGER) AS stratum, {_label_sql()} AS label FROM s
""")
def c6_strata(spark, sf_dir):
    """Cumulative-sqrt(f) strata (5 strata, 50 classes) of customer
    balances, with ordered labels."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = P.cum_root_f(c, "c_acctbal", strata=5, bins=50)
    return s.select("c_custkey", F.col("stratum").cast("int").alias("stratum"),
                    P.stratum_labels("stratum").alias("label"))


_C8_SQL = _P2_SQL + f""",
eci AS (WITH {ECI_SQL} SELECT name, value FROM eci),
v AS (SELECT icap_index AS x, value AS y FROM idx JOIN eci ON entidad = regexp_replace(name, ', .+', ''))
SELECT 'eci' AS var1, 'icap_index' AS var2,
       {R6('covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)')} AS corr, count(*) AS n FROM v
"""


@query("c8_validation", sql=_C8_SQL)
def c8_validation(spark, sf_dir):
    """Index validated against economic complexity: inner join on
    differing keys (nation vs 'nation, region' split) and correlation."""
    idx, _ = icap(spark, sf_dir)
    m = C.incidence(C.rca(region_product(spark, sf_dir)))
    eci, _ = C.complexity_index(m)
    eci = eci.select(X.remove_first("name", ", .+").alias("state"),
                     F.col("value").alias("eci"))
    v = J.join_keys(idx, eci, [("entidad", "state")], "inner")
    c = A.correlation_long(v, ["icap_index", "eci"], n="n").where(F.col("var1") < F.col("var2"))
    return c.withColumn("corr", r6("corr"))
