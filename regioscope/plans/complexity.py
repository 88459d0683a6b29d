"""Products D and E: complexity, proximity, networks, industry advantage.

The long table ``region_product`` (supplier 'nation, region' x part name,
summed extended price) stands in for the census cells.  Iterative measures
have generated SQL twins (one materialised CTE per round).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from regioscope.functions import text as X
from regioscope.functions.rsem import cols_between, round_numeric
from regioscope.operators import aggregates as A
from regioscope.operators import complexity as C
from regioscope.operators import joins as J
from regioscope.plans.bindings import load, r2, r6, region_product
from regioscope.plans.registry import R2, R6, query
from regioscope.plans.tables import RP_SQL

FITNESS_ROUNDS = 20
ECI_ROUNDS = 20

M_SQL = RP_SQL + """,
cells AS (SELECT country AS region, product, sum(value) AS value
          FROM rp WHERE value IS NOT NULL GROUP BY 1, 2),
rt AS (SELECT region, sum(value) AS rt FROM cells GROUP BY 1),
pt AS (SELECT product, sum(value) AS pt FROM cells GROUP BY 1),
rcat AS MATERIALIZED (
  SELECT c.region, c.product, c.value,
         (c.value / rt) / (pt / (SELECT sum(value) FROM cells)) AS rca
  FROM cells c JOIN rt USING (region) JOIN pt USING (product)),
m AS MATERIALIZED (SELECT region, product FROM rcat WHERE rca >= 1)
"""


def _m(spark, sf_dir):
    return C.incidence(C.rca(region_product(spark, sf_dir)))


@query("x2_rca_signed", sql=f"""
WITH cells AS (SELECT c_nationkey AS region, c_mktsegment AS product, sum(c_acctbal - 4500) AS value FROM customer GROUP BY 1, 2),
rt AS (SELECT region, sum(value) AS rt FROM cells GROUP BY 1),
pt AS (SELECT product, sum(value) AS pt FROM cells GROUP BY 1)
SELECT region, product, {R6('value')} AS value,
       {R6('(value / nullif(rt, 0)) / nullif(pt / nullif((SELECT sum(value) FROM cells), 0), 0)', 3)} AS rca
FROM cells JOIN rt USING (region) JOIN pt USING (product)
""")
def x2_rca_signed(spark, sf_dir):
    """RCA of values of both signs: negative cells stay in the totals."""
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("product"),
                                               (F.col("c_acctbal") - 4500).alias("value"))
    r = C.rca(c)
    return r.select("region", "product", r6("value").alias("value"), r6("rca", 3).alias("rca"))


@query("x2_rca", sql="WITH " + M_SQL + f"""
SELECT region, product, {R6('value')} AS value, {R6('rca')} AS rca,
       CAST(rca >= 1 AS INTEGER) AS m FROM rcat
""")
def x2_rca(spark, sf_dir):
    """Balassa RCA, continuous and discrete (cut-off 1)."""
    r = C.rca(region_product(spark, sf_dir))
    return r.select("region", "product", r6("value").alias("value"),
                    r6("rca").alias("rca"), "m")


def _prox_sql(on: str) -> str:
    other = "region" if on == "product" else "product"
    return f"""
, k AS (SELECT {on} AS item, count(*) AS k FROM m GROUP BY 1),
px AS (SELECT x.{on} AS a, y.{on} AS b, count(*) AS co
       FROM m x JOIN m y ON x.{other} = y.{other} AND x.{on} < y.{on} GROUP BY 1, 2)
"""


@query("x4_proximity_products", sql="WITH " + M_SQL + _prox_sql("product") + f"""
SELECT a, b, {R6('co / greatest(ka.k, kb.k)')} AS phi
FROM px JOIN k ka ON ka.item = a JOIN k kb ON kb.item = b
""")
def x4_proximity_products(spark, sf_dir):
    p = C.proximity(_m(spark, sf_dir), on="product")
    return p.withColumn("phi", r6("phi"))


@query("x4_proximity_regions", sql="WITH " + M_SQL + _prox_sql("region") + f"""
SELECT a, b, {R6('co / greatest(ka.k, kb.k)')} AS phi
FROM px JOIN k ka ON ka.item = a JOIN k kb ON kb.item = b
""")
def x4_proximity_regions(spark, sf_dir):
    p = C.proximity(_m(spark, sf_dir), on="region")
    return p.withColumn("phi", r6("phi"))


REL_TAIL = _prox_sql("product") + """,
phi AS (SELECT a, b, co / greatest(ka.k, kb.k) AS phi
        FROM px JOIN k ka ON ka.item = a JOIN k kb ON kb.item = b),
sym AS (SELECT a, b, phi FROM phi UNION ALL SELECT b AS a, a AS b, phi FROM phi),
den AS (SELECT b AS product, sum(phi) AS den FROM sym GROUP BY 1),
num AS (SELECT region, b AS product, sum(phi) AS num FROM m JOIN sym ON m.product = sym.a
        GROUP BY 1, 2),
rel AS (SELECT region, product, num / den AS density FROM num JOIN den USING (product))
"""
RELATEDNESS_SQL = M_SQL + REL_TAIL


@query("x6_relatedness", sql="WITH " + RELATEDNESS_SQL + f"""
SELECT region, product, {R6('density')} AS density FROM rel
""")
def x6_relatedness(spark, sf_dir):
    m = _m(spark, sf_dir)
    rel = C.relatedness(m, C.proximity(m, on="product"))
    return rel.withColumn("density", r6("density"))


def _fitness_sql(rounds: int) -> str:
    parts = ["f0 AS MATERIALIZED (SELECT DISTINCT region AS name, CAST(1.0 AS DOUBLE) AS value FROM m)",
             "q0 AS MATERIALIZED (SELECT DISTINCT product AS name, CAST(1.0 AS DOUBLE) AS value FROM m)"]
    for i in range(1, rounds + 1):
        parts.append(f"f{i}r AS (SELECT m.region AS name, sum(q{i-1}.value) AS value "
                     f"FROM m JOIN q{i-1} ON m.product = q{i-1}.name GROUP BY 1)")
        parts.append(f"f{i} AS MATERIALIZED (SELECT name, value / (SELECT avg(value) FROM f{i}r) "
                     f"AS value FROM f{i}r)")
        parts.append(f"q{i}r AS (SELECT m.product AS name, 1.0 / sum(1.0 / f{i-1}.value) AS value "
                     f"FROM m JOIN f{i-1} ON m.region = f{i-1}.name GROUP BY 1)")
        parts.append(f"q{i} AS MATERIALIZED (SELECT name, value / (SELECT avg(value) FROM q{i}r) "
                     f"AS value FROM q{i}r)")
    return ",\n".join(parts)


FITNESS_SQL = M_SQL + ",\n" + _fitness_sql(FITNESS_ROUNDS)


@query("x3_fitness", sql="WITH " + FITNESS_SQL + f"""
SELECT 'region' AS kind, name, {R6('value')} AS value FROM f{FITNESS_ROUNDS}
UNION ALL
SELECT 'product' AS kind, name, {R6('value')} AS value FROM q{FITNESS_ROUNDS}
""")
def x3_fitness(spark, sf_dir):
    """Fitness of regions and complexity of products, 20 rounds."""
    f, q = C.fitness(_m(spark, sf_dir), iterations=FITNESS_ROUNDS)
    return (f.select(F.lit("region").alias("kind"), "name", r6("value").alias("value"))
            .unionByName(q.select(F.lit("product").alias("kind"), "name",
                                  r6("value").alias("value"))))


def _eci_sql(rounds: int) -> str:
    parts = ["kc AS (SELECT region, CAST(count(*) AS DOUBLE) AS kc FROM m GROUP BY 1)",
             "kp AS (SELECT product, CAST(count(*) AS DOUBLE) AS kp FROM m GROUP BY 1)",
             "mk AS MATERIALIZED (SELECT m.region, m.product, kc, kp FROM m JOIN kc USING (region) "
             "JOIN kp USING (product))",
             "x0 AS MATERIALIZED (SELECT region, kc AS x FROM kc)"]
    for i in range(1, rounds + 1):
        parts.append(f"y{i} AS (SELECT product, sum(x) / kp AS y FROM mk JOIN x{i-1} USING (region) "
                     f"GROUP BY product, kp)")
        parts.append(f"x{i}a AS (SELECT region, kc, sum(y) / kc AS x FROM mk JOIN y{i} USING (product) "
                     f"GROUP BY region, kc)")
        parts.append(f"x{i}b AS (SELECT region, x - (SELECT sum(kc * x) / sum(kc) FROM x{i}a) AS x "
                     f"FROM x{i}a)")
        parts.append(f"x{i} AS MATERIALIZED (SELECT region, x / nullif((SELECT stddev_samp(x) "
                     f"FROM x{i}b), 0) AS x FROM x{i}b)")
    n = rounds
    parts.append(f"z AS (SELECT region, (x - (SELECT avg(x) FROM x{n})) / "
                 f"nullif((SELECT stddev_samp(x) FROM x{n}), 0) AS x FROM x{n})")
    parts.append("sg AS (SELECT CASE WHEN covar_samp(x, kc) / nullif(stddev_samp(x) * "
                 "stddev_samp(kc), 0) < 0 THEN -1.0 ELSE 1.0 END AS s FROM z JOIN kc USING (region))")
    parts.append("eci AS MATERIALIZED (SELECT region AS name, x * (SELECT s FROM sg) AS value FROM z)")
    parts.append("py AS (SELECT product, sum(value) / kp AS y FROM mk JOIN eci ON mk.region = eci.name "
                 "GROUP BY product, kp)")
    parts.append("pci AS MATERIALIZED (SELECT product AS name, (y - (SELECT avg(y) FROM py)) / "
                 "nullif((SELECT stddev_samp(y) FROM py), 0) AS value FROM py)")
    return ",\n".join(parts)


ECI_SQL = M_SQL + ",\n" + _eci_sql(ECI_ROUNDS)


@query("x5_eci_pci", sql="WITH " + ECI_SQL + f"""
SELECT 'eci' AS kind, name, {R6('value')} AS value FROM eci
UNION ALL
SELECT 'pci' AS kind, name, {R6('value')} AS value FROM pci
""")
def x5_eci_pci(spark, sf_dir):
    """Economic complexity of regions and complexity of products."""
    eci, pci = C.complexity_index(_m(spark, sf_dir), iterations=ECI_ROUNDS)
    return (eci.select(F.lit("eci").alias("kind"), "name", r6("value").alias("value"))
            .unionByName(pci.select(F.lit("pci").alias("kind"), "name",
                                    r6("value").alias("value"))))


def region_network(spark, sf_dir, avg_links: float = 4.0):
    m = _m(spark, sf_dir)
    return C.project_network(C.proximity(m, on="region"), avg_links=avg_links)


def _tree_sql(side: str) -> str:
    """CTEs ``tree``, ``rest`` and ``n``: an edge belongs to the maximum
    spanning tree if its ends are not connected by edges above it in the order
    (weight, a, b)."""
    return "WITH RECURSIVE " + M_SQL + _prox_sql(side) + """,
e AS MATERIALIZED (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS r FROM (
  SELECT a, b, co / greatest(ka.k, kb.k) AS w
  FROM px JOIN k ka ON ka.item = a JOIN k kb ON kb.item = b)),
reach(r, node) AS (
  SELECT r, a FROM e
  UNION
  SELECT q.r, CASE WHEN x.a = q.node THEN x.b ELSE x.a END
  FROM reach q JOIN e x ON x.r > q.r AND (x.a = q.node OR x.b = q.node)),
tree AS MATERIALIZED (SELECT * FROM e WHERE NOT EXISTS (
  SELECT 1 FROM reach q WHERE q.r = e.r AND q.node = e.b)),
rest AS (SELECT * FROM e WHERE r NOT IN (SELECT r FROM tree)),
n AS (SELECT (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM tree UNION ALL SELECT b FROM tree)) AS nodes,
             (SELECT count(*) FROM tree) AS edges)"""


KTH_SQL = """
kth AS (SELECT min(w) AS w FROM (SELECT w, row_number() OVER (ORDER BY w DESC) AS i FROM rest)
        WHERE i <= (SELECT ceil(4.0 * nodes / 2) - edges FROM n))"""

NETWORK_SQL = _tree_sql("region") + "," + KTH_SQL + f"""
SELECT a, b, {R6('w')} AS weight, true AS in_tree FROM tree
UNION ALL
SELECT a, b, {R6('w')} AS weight, false AS in_tree FROM rest WHERE w >= (SELECT w FROM kth)
"""


@query("x7_network", sql=NETWORK_SQL)
def x7_network(spark, sf_dir):
    """Region network: maximum spanning tree of proximity plus the
    strongest extra edges up to a mean degree of 4."""
    net = region_network(spark, sf_dir)
    return net.select("a", "b", r6("weight").alias("weight"), "in_tree")


TOLERANCE = 0.01


@query("x7_network_products", sql=_tree_sql("product") + f""",
step AS (SELECT min(i) * CAST({TOLERANCE} AS DOUBLE) AS w FROM range(200) t(i)
         WHERE (SELECT count(*) FROM rest WHERE rest.w > i * CAST({TOLERANCE} AS DOUBLE)) <= (SELECT 4.0 * nodes / 2 - edges FROM n))
SELECT a, b, {R6('w')} AS weight, true AS in_tree FROM tree
UNION ALL
SELECT a, b, {R6('w')} AS weight, false AS in_tree FROM rest WHERE w > (SELECT w FROM step)
UNION ALL
SELECT DISTINCT product, NULL, CAST(NULL AS DOUBLE), false FROM rp
WHERE product NOT IN (SELECT a FROM tree UNION ALL SELECT b FROM tree)
""")
def x7_network_products(spark, sf_dir):
    """Product network: the tree and the edges above the first threshold, in
    steps of the tolerance, that leaves a mean degree of at most 4; products
    without an edge are listed."""
    phi = C.proximity(_m(spark, sf_dir), on="product")
    products = region_product(spark, sf_dir).select(F.col("product").alias("name"))
    net = C.project_network(phi, avg_links=4.0, tolerance=TOLERANCE, nodes=products)
    return net.select("a", "b", r6("weight").alias("weight"), "in_tree")


def _betweenness_sql(edges: str) -> str:
    """CTEs up to ``btw`` (name, betweenness): distances by min-plus squaring,
    shortest paths counted one by one along the edges they may take."""
    squares = "".join(f""",
d{i} AS MATERIALIZED (SELECT x.s, y.v, min(x.dist + y.dist) AS dist FROM d{i - 1} x JOIN d{i - 1} y ON x.v = y.s GROUP BY 1, 2)"""
                      for i in range(1, 6))  # paths of up to 32 edges: there are 25 regions
    same = "abs({} - {}) <= 1e-9 * greatest(1.0, {})"
    return f"""
ed AS MATERIALIZED (SELECT a AS u, b AS x, w FROM ({edges}) UNION ALL SELECT b, a, w FROM ({edges})),
d0 AS (SELECT u AS s, x AS v, w AS dist FROM ed UNION ALL SELECT DISTINCT u, u, 0.0 FROM ed){squares},
dag AS MATERIALIZED (SELECT p.s, ed.u, ed.x FROM d5 p JOIN ed ON p.v = ed.u JOIN d5 q ON q.s = p.s AND q.v = ed.x
                     WHERE {same.format('p.dist + w', 'q.dist', 'q.dist')}),
path(s, v) AS (SELECT DISTINCT u, u FROM ed UNION ALL SELECT path.s, dag.x FROM path JOIN dag ON path.s = dag.s AND path.v = dag.u),
sg AS MATERIALIZED (SELECT s, v, count(*) AS n FROM path GROUP BY 1, 2),
btw AS MATERIALIZED (
  SELECT sv.v AS name, sum(a.n * b.n / st.n) / 2 AS betweenness
  FROM d5 st_d JOIN sg st ON st.s = st_d.s AND st.v = st_d.v
  JOIN d5 sv ON sv.s = st_d.s JOIN d5 vt ON vt.s = sv.v AND vt.v = st_d.v
  JOIN sg a ON a.s = sv.s AND a.v = sv.v JOIN sg b ON b.s = vt.s AND b.v = vt.v
  WHERE sv.v NOT IN (st_d.s, st_d.v) AND st_d.s <> st_d.v AND {same.format('sv.dist + vt.dist', 'st_d.dist', 'st_d.dist')}
  GROUP BY 1)"""


@query("x9_centrality", sql=_tree_sql("region") + "," + KTH_SQL + f""",
net AS MATERIALIZED (SELECT a, b, w FROM tree UNION ALL SELECT a, b, w FROM rest WHERE w >= (SELECT w FROM kth)),
{_betweenness_sql("SELECT a, b, w FROM net")},
deg AS (SELECT u AS name, count(*) AS degree FROM ed GROUP BY 1),
gva AS (SELECT country AS name, sum(value) AS gva FROM rp GROUP BY 1),
fit AS (WITH {FITNESS_SQL} SELECT name, value FROM f{FITNESS_ROUNDS})
SELECT k.name, regexp_replace(nullif(regexp_extract(k.name, ', .+'), ''), ', ', '') AS state,
       regexp_replace(k.name, ', .+', '') AS municipality, coalesce(degree, 0) AS degree,
       {R6('coalesce(betweenness, 0)')} AS betweenness, {R6('gva')} AS gross_value_added, {R6('fit.value')} AS complexity_index
FROM (SELECT DISTINCT region AS name FROM m) k LEFT JOIN deg USING (name) LEFT JOIN btw USING (name)
LEFT JOIN gva USING (name) LEFT JOIN fit USING (name)
""")
def x9_centrality(spark, sf_dir):
    """Degree and betweenness of every node of the region network, plus
    the node decoration: municipality / state split of the composite name,
    summed value and fitness (X8-X10)."""
    m = _m(spark, sf_dir)
    net = C.project_network(C.proximity(m, on="region"))
    nodes = m.select(F.col("region").alias("name")).distinct()
    nodes = nodes.join(C.degree(net), "name", "left").join(C.betweenness(net, weighted=True), "name", "left") \
        .fillna(0, ["degree", "betweenness"])  # a region without an edge is a node too
    t = node_table(spark, sf_dir, nodes)
    return t.withColumns({c: r6(c) for c in ("betweenness", "gross_value_added", "complexity_index")})


def node_table(spark, sf_dir, nodes):
    """Split 'municipality, state' names and attach value and fitness."""
    rp = region_product(spark, sf_dir)
    value = A.sum_by(rp, "country")
    f, _ = C.fitness(_m(spark, sf_dir), iterations=FITNESS_ROUNDS)
    out = (nodes.join(value, "name", "left")
           .join(f.withColumnRenamed("value", "complexity_index"), "name", "left"))
    return out.select(
        "name",
        X.remove_first(X.extract("name", ", .+"), ", ").alias("state"),
        X.remove_first("name", ", .+").alias("municipality"),
        *[c for c in out.columns if c not in ("name",)])


@query("x10_node_table", sql="WITH " + FITNESS_SQL + f"""
, v AS (SELECT country AS name, sum(value) AS gva FROM rp GROUP BY 1)
SELECT v.name,
       regexp_replace(nullif(regexp_extract(v.name, ', .+'), ''), ', ', '') AS state,
       regexp_replace(v.name, ', .+', '') AS municipality,
       {R6('gva')} AS gross_value_added, {R6(f'f{FITNESS_ROUNDS}.value')} AS complexity_index
FROM v LEFT JOIN f{FITNESS_ROUNDS} ON v.name = f{FITNESS_ROUNDS}.name
""")
def x10_node_table(spark, sf_dir):
    """Node attributes for every region: name split, value, fitness."""
    rp = region_product(spark, sf_dir)
    nodes = rp.select(F.col("country").alias("name")).distinct()
    t = node_table(spark, sf_dir, nodes)
    return t.select("name", "state", "municipality",
                    r6("gross_value_added").alias("gross_value_added"),
                    r6("complexity_index").alias("complexity_index"))


@query("x11_products_in_region", sql="WITH " + M_SQL + """
SELECT product FROM rcat
WHERE regexp_matches(region, 'AMERICA') AND regexp_matches(region, 'NATION_1,')
""")
def x11_products_in_region(spark, sf_dir):
    """Products a region has (any value), selected by two name patterns."""
    r = C.rca(region_product(spark, sf_dir))
    return r.where(X.detect("region", "AMERICA") & X.detect("region", "NATION_1,")) \
        .select("product")


# -- industry advantage table (X12) --------------------------------------------

# The reference reports one state; the registered plan covers every region
# (pass a nation name to ``advantage_table`` for the one-region report).
ADV_REGION = None
_HOURS_ZERO = "ring"


def _census(spark, sf_dir, region=None):
    """City census per activity for one region: production, value added,
    expenses, income, staff, hours (zero for one activity family)."""
    li = load(spark, sf_dir, "lineitem")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    sn = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    if region is not None:
        sn = sn.where(F.col("n_name") == region)
    sn = sn.select("s_suppkey", F.concat_ws(", ", "n_name", "r_name").alias("state_id"))
    j = li.join(J.broadcast_if_small(sn), li.l_suppkey == sn.s_suppkey) \
        .join(p, li.l_partkey == p.p_partkey)
    hours = F.when(F.col("p_name").contains(_HOURS_ZERO), F.lit(0.0)).otherwise(F.col("l_quantity"))
    c = j.groupBy("state_id", F.col("p_name").alias("national_industry_id")).agg(
        F.count(F.lit(1)).cast("double").alias("economic_units"),
        F.sum("l_extendedprice").alias("gross_production"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("gross_added_value"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("total_expenses"),
        F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("total_income"),
        F.sum("l_quantity").alias("employees"),
        F.sum(hours).alias("worked_hours"))
    return c.withColumns({
        "gav_per_worked_hour": F.try_divide(1000 * F.col("gross_added_value"), F.col("worked_hours")),
        "productivity": F.try_divide(1000 * F.col("gross_production"), F.col("worked_hours"))})


_ADV_NUM = ["employees_number", "activities_complexity_index", "affinity",
            "relative_comparative_advantage", "gross_production", "gross_added_value",
            "total_expenses", "total_income", "worked_hours", "gav_per_worked_hour",
            "productivity"]


@query("x12_advantage_table", sql="WITH " + ECI_SQL + REL_TAIL + f"""
, rel_r AS (SELECT c.region AS state_id, c.product AS national_industry_id,
                   upper(c.product) AS national_industry, c.value AS employees_number,
                   CASE WHEN den.den IS NOT NULL THEN coalesce(rel.density, 0) END AS affinity,
                   c.rca AS relative_comparative_advantage
            FROM rcat c LEFT JOIN rel ON rel.region = c.region AND rel.product = c.product
                        LEFT JOIN den ON den.product = c.product),
pci_t AS (SELECT name AS national_industry_id, upper(name) AS national_industry,
                 value AS activities_complexity_index FROM pci),
census AS (
  SELECT n_name || ', ' || r_name AS state_id, p_name AS national_industry_id,
         CAST(count(*) AS DOUBLE) AS economic_units,
         sum(l_extendedprice) AS gross_production,
         sum(l_extendedprice * (1 - l_discount)) AS gross_added_value,
         sum(l_extendedprice * l_discount) AS total_expenses,
         sum(l_extendedprice * (1 + l_tax)) AS total_income,
         sum(l_quantity) AS employees,
         sum(CASE WHEN contains(p_name, '{_HOURS_ZERO}') THEN 0.0 ELSE l_quantity END) AS worked_hours
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2),
adv AS (
  SELECT r.state_id, r.national_industry_id, r.national_industry, r.employees_number,
         p.activities_complexity_index, r.affinity, r.relative_comparative_advantage,
         c.gross_production, c.gross_added_value, c.total_expenses, c.total_income,
         c.worked_hours,
         1000 * c.gross_added_value / nullif(c.worked_hours, 0) AS gav_per_worked_hour,
         1000 * c.gross_production / nullif(c.worked_hours, 0) AS productivity
  FROM pci_t p JOIN rel_r r USING (national_industry_id, national_industry)
       LEFT JOIN census c ON c.national_industry_id = r.national_industry_id
                         AND c.state_id = r.state_id)
SELECT state_id, national_industry_id, national_industry,
       {", ".join(f"{R2(c)} AS {c}" for c in _ADV_NUM)}
FROM adv
""")
def x12_advantage_table(spark, sf_dir):
    """Industry advantage table for every region: activity complexity (PCI)
    inner-joined to affinity and RCA on a composite key, left-joined to
    the census on a composite key, ratio metrics, rounded to 2 places,
    sorted by RCA."""
    return advantage_table(spark, sf_dir, ADV_REGION)


def advantage_table(spark, sf_dir, region=None):
    """The advantage table, for all regions or one nation (``region``)."""
    m_all = C.rca(region_product(spark, sf_dir))
    m = C.incidence(m_all)
    _, pci = C.complexity_index(m, iterations=ECI_ROUNDS)
    rel = C.relatedness(m, C.proximity(m, on="product"), cells=m_all)
    pci_t = pci.select(F.col("name").alias("national_industry_id"),
                       F.upper("name").alias("national_industry"),
                       F.col("value").alias("activities_complexity_index"))
    rows = m_all if region is None else m_all.where(F.col("region").startswith(region + ","))
    rel_r = (rows.join(rel, ["region", "product"], "left")
             .select(F.col("region").alias("state_id"),
                     F.col("product").alias("national_industry_id"),
                     F.upper("product").alias("national_industry"),
                     F.col("value").alias("employees_number"),
                     F.col("density").alias("affinity"),
                     F.col("rca").alias("relative_comparative_advantage")))
    adv = J.join_keys(pci_t, rel_r, ["national_industry_id", "national_industry"], "inner")
    adv = J.join_keys(adv, _census(spark, sf_dir, region), ["national_industry_id", "state_id"],
                      "left")
    # positional ranges, resolved once against the column order
    census_cols = cols_between(adv, "gross_production", "total_income") + \
        cols_between(adv, "worked_hours", "productivity")
    adv = adv.select("state_id", "national_industry_id", "national_industry",
                     "employees_number", "activities_complexity_index", "affinity",
                     "relative_comparative_advantage", *census_cols)
    adv = round_numeric(adv, 2)
    return adv.orderBy(F.col("relative_comparative_advantage").desc_nulls_last())
