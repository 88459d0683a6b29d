"""Input forms and column work that the larger plans take for granted: pruned
scans, JSON cubes, recoding, the complexity input table, global order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from regioscope.functions import geo as G
from regioscope.functions import rsem as R
from regioscope.operators import joins as J
from regioscope.operators import windows as W
from regioscope.plans.bindings import load, r6, registry
from regioscope.plans.establishments import REGISTRY_SQL
from regioscope.plans.geo import CAMPUS_LAT, CAMPUS_LON
from regioscope.plans.registry import R6, query
from regioscope.sources import io as IO


@query("s2_csv_pruned", sql="WITH " + REGISTRY_SQL + """
SELECT cve_ent, "tipoUniEco", CAST(make_date(2000 + CAST(cve_mun AS INTEGER) % 30, CAST(cve_mun AS INTEGER) % 12 + 1, 1) AS DATE)
       AS period, CAST(count(*) AS BIGINT) AS n, CAST(count(nom_estab) AS BIGINT) AS named
FROM registry GROUP BY 1, 2, 3
""")
def s2_csv_pruned(spark, sf_dir):
    """The registry as UTF-8 CSV, one folder per snapshot named
    with MMYY, read back as typed strings with only the columns in use, the
    month from the folder name, as a named and cached table."""
    mun = F.col("cve_mun").cast("int")
    snap = F.concat(F.lpad((mun % 12 + 1).cast("string"), 2, "0"), F.lpad((mun % 30).cast("string"), 2, "0"))
    rows = registry(spark, sf_dir).select("id", "nom_estab", "cve_ent", "tipoUniEco", "per_ocu",
                                          F.concat(F.lit("denue_"), snap).alias("snap"))
    path = IO.scratch_path(spark, "registry")
    IO.write_csv(rows, path, partition_by=["snap"])
    df = IO.read_csv(spark, path, "id string, nom_estab string, cve_ent string, tipoUniEco string, per_ocu string",
                     columns=["nom_estab", "cve_ent", "tipoUniEco"], with_path=True)
    df = IO.with_period_from_path(df, component=-2)
    IO.register(df, "registry_snapshots", cache=True)
    return spark.sql("SELECT cve_ent, tipoUniEco, period, count(*) AS n, count(nom_estab) AS named "
                     "FROM registry_snapshots GROUP BY cve_ent, tipoUniEco, period")


@query("s7_json_cube", sql=f"""
SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS municipality_id, count(*) AS customers,
       {R6('sum(c_acctbal)')} AS balance FROM customer GROUP BY 1
""")
def s7_json_cube(spark, sf_dir):
    """Documents ``{"data": [records]}`` landed as JSON, one per segment,
    exploded to typed rows (ids stay strings) and aggregated."""
    c = load(spark, sf_dir, "customer")
    record = F.struct(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("municipality_id"),
                      F.col("c_acctbal").alias("balance"))
    # documents of bounded size, as an API pages its answers
    docs = c.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000).alias("page")).agg(F.collect_list(record).alias("data"))
    path = IO.scratch_path(spark, "cube")
    docs.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    rows = IO.read_json_cube(spark, path, "municipality_id string, balance double", multiline=False)
    return rows.groupBy("municipality_id").agg(F.count(F.lit(1)).alias("customers"), r6(F.sum("balance")).alias("balance"))


# Binding values: names that one source spells otherwise.
OTHER_NAMES = {"NATION_3": "Nation Three", "NATION_7": "Nation Seven", "NATION_19": "Nation Nineteen"}


@query("f12_recode", sql="WITH " + REGISTRY_SQL + f"""
SELECT CASE municipio {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in OTHER_NAMES.items())} ELSE municipio END AS municipio,
       coalesce(tipo_asent, '<NA>') AS tipo_asent, coalesce(tipo_vial, 'Sin vialidad') AS tipo_vial,
       count(*) AS n, {R6('ln(count(*))')} AS log_n, {R6('1.0 / count(*)')} AS weight,
       {R6('least(count(*) / 40.0, 0.5)')} AS capped, {R6('exp(least(count(*) / 40.0, 0.5))')} AS odds
FROM registry GROUP BY 1, 2, 3
""")
def f12_recode(spark, sf_dir):
    """F12 recoded names, F13 a level for missing values, F17 log, inverse
    weight, cap and exp."""
    r = registry(spark, sf_dir).select(
        R.value_map("municipio", OTHER_NAMES).alias("municipio"), R.with_na_level("tipo_asent").alias("tipo_asent"),
        F.coalesce("tipo_vial", F.lit("Sin vialidad")).alias("tipo_vial"))
    g = r.groupBy("municipio", "tipo_asent", "tipo_vial").agg(F.count(F.lit(1)).alias("n"))
    capped = R.cap(F.col("n") / 40.0, 0.5)
    return g.select(*g.columns, r6(F.ln("n")).alias("log_n"), r6(R.safe_div(F.lit(1.0), F.col("n"))).alias("weight"),
                    r6(capped).alias("capped"), r6(F.exp(capped)).alias("odds"))


@query("p7_bulk_cast", sql="""
SELECT "c_mktsegment" AS segment, CAST(sum(try_cast(CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END
       AS DOUBLE)) AS BIGINT) AS nations, count(*) FILTER (c_custkey % 5 = 0) AS unread,
       CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_debt
FROM customer GROUP BY 1
""")
def p7_bulk_cast(spark, sf_dir):
    """Text columns cast to numbers in bulk (bad text is missing),
    logical columns to 0/1."""
    c = load(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("in_debt"),
        F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    c = R.logical_to_double(R.cast_all(c, ["nation"]))
    return c.groupBy("segment").agg(F.sum("nation").cast("long").alias("nations"),
                                    F.count_if(F.col("nation").isNull()).alias("unread"),
                                    F.sum("in_debt").cast("long").alias("in_debt"))


@query("x1_complexity_inputs", sql=f"""
WITH census AS (
  SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS entidad,
         CASE WHEN s_nationkey % 7 <> 3 THEN lpad(CAST(s_nationkey AS VARCHAR), 3, '0') END AS municipio,
         CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN '46' || lpad(CAST(l_partkey % 97 AS VARCHAR), 2, '0')
              ELSE '46' || lpad(CAST(l_partkey % 97 AS VARCHAR), 4, '0') END AS codigo,
         CASE WHEN l_linenumber <> 7 THEN l_quantity END AS a131a
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
catalogue AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS municipio,
                     n_name || ' ' || r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 5)
SELECT country, codigo AS product, {R6('a131a')} AS value FROM (
  SELECT DISTINCT c.entidad, c.entidad || c.municipio AS municipio, codigo, a131a, country
  FROM census c LEFT JOIN catalogue g ON c.entidad || c.municipio = g.municipio
  WHERE c.municipio IS NOT NULL AND codigo IS NOT NULL AND length(codigo) = 6)
WHERE a131a IS NOT NULL
""")
def x1_complexity_inputs(spark, sf_dir):
    """Census rows with a municipality and a six-digit code, keyed by
    state and municipality, named from the catalogue (kept when it lacks
    them), each distinct row once, values present."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = load(spark, sf_dir, "nation")   # nation and region are fixed at every scale factor
    r = load(spark, sf_dir, "region")
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    part = F.col("l_partkey")
    census = (J.broadcast_or_salted(li, s, "l_suppkey").join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey).select(
        pad(F.col("n_regionkey"), 2).alias("entidad"),
        F.when(F.col("s_nationkey") % 7 != 3, pad(F.col("s_nationkey"), 3)).alias("municipio"),
        F.when(part % 11 == 0, None).when(part % 10 == 0, F.concat(F.lit("46"), pad(part % 97, 2)))
        .otherwise(F.concat(F.lit("46"), pad(part % 97, 4))).alias("codigo"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("a131a")))
    catalogue = n.where("n_nationkey != 5").join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(pad(F.col("n_regionkey"), 2), pad(F.col("n_nationkey"), 3)).alias("municipio"),
        F.concat_ws(" ", "n_name", "r_name").alias("country"))
    rows = (census.where(F.col("municipio").isNotNull() & F.col("codigo").isNotNull() & (F.length("codigo") == 6))
            .withColumn("municipio", F.concat("entidad", "municipio")).dropDuplicates())
    named = J.join_keys(rows, F.broadcast(catalogue), ["municipio"], "left")
    return named.where(F.col("a131a").isNotNull()).select("country", F.col("codigo").alias("product"), r6("a131a").alias("value"))


@query("o1_sorted", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
""")
def o1_sorted(spark, sf_dir):
    """O1: the sort order as a column, over all orders."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return W.global_rank(o, [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query("o3_category_order", sql=f"""
WITH m AS (SELECT c_nationkey, o_orderpriority, {R6('avg(o_totalprice)')} AS mean_price
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY mean_price, c_nationkey, o_orderpriority) AS place FROM m
""")
def o3_category_order(spark, sf_dir):
    """O3: categories placed by a metric."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = (o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", "o_orderpriority")
         .agg(r6(F.avg("o_totalprice")).alias("mean_price")))
    return W.global_rank(m, [F.asc_nulls_last("mean_price"), F.asc("c_nationkey"), F.asc("o_orderpriority")], "place")


UTM_ZONE = 14


def _utm_sql(lon: str, lat: str) -> str:
    """(x, y) of the zone as SQL, spelled with the series' numbers."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    e = math.sqrt(f * (2 - f))
    al = [n / 2 - 2 / 3 * n ** 2 + 5 / 16 * n ** 3, 13 / 48 * n ** 2 - 3 / 5 * n ** 3, 61 / 240 * n ** 3]
    d = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    t = f"sinh(atanh(sin(radians({lat}))) - {d(e)} * atanh({d(e)} * sin(radians({lat}))))"
    lam = f"radians({lon} - ({6 * UTM_ZONE - 183}))"
    return (f"SELECT *, {d(a)} * (eta + {' + '.join(f'{d(v)} * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, v in enumerate(al, 1))})"
            f" + 500000 AS x, {d(a)} * (xi + {' + '.join(f'{d(v)} * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, v in enumerate(al, 1))})"
            f" AS y FROM (SELECT *, atan2({t}, cos({lam})) AS xi, atanh(sin({lam}) / sqrt(1 + pow({t}, 2))) AS eta FROM p)")


@query("g2_metric_points", sql="WITH " + REGISTRY_SQL + f""",
p AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN NULL ELSE longitud END AS lon, latitud AS lat FROM registry
      UNION ALL SELECT 'campus', CAST('{CAMPUS_LON!r}' AS DOUBLE), CAST('{CAMPUS_LAT!r}' AS DOUBLE)),
u AS ({_utm_sql('lon', 'lat')})
SELECT id, lon IS NOT NULL AS placed, {R6('x', 3)} AS x, {R6('y', 3)} AS y,
       {R6("sqrt(pow(x - (SELECT x FROM u WHERE id = 'campus'), 2) + pow(y - (SELECT y FROM u WHERE id = 'campus'), 2))", 3)} AS metres
FROM u WHERE id <> 'campus'
""")
def g2_metric_points(spark, sf_dir):
    """Coordinates to points (a missing coordinate gives none),
    reprojected to metres, and their distances to the campus."""
    lon = F.when(F.col("id").cast("long") % 17 != 0, F.col("longitud"))
    p = registry(spark, sf_dir).select("id", G.point(lon, "latitud").alias("point"))
    x, y = G.utm_xy(F.col("point.x"), F.col("point.y"), UTM_ZONE)
    x0, y0 = G.utm_xy(F.lit(CAMPUS_LON), F.lit(CAMPUS_LAT), UTM_ZONE)
    return p.select("id", F.col("point").isNotNull().alias("placed"), r6(x, 3).alias("x"), r6(y, 3).alias("y"),
                    r6(F.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)), 3).alias("metres"))


_LEVELS = {"sector_id": 2, "subsector_id": 3, "industry_group_id": 4}


@query("j3_five_keys_left", sql="WITH " + REGISTRY_SQL + f""",
r AS (SELECT cve_ent AS state_id, {', '.join(f'substr(codigo_act, 1, {n}) AS {c}' for c, n in _LEVELS.items())},
             codigo_act AS national_industry_id, per_ocu, tipo_vial, length(raz_social) AS chars FROM registry
      WHERE length(codigo_act) = 6),
u AS (SELECT state_id, sector_id, subsector_id, industry_group_id, national_industry_id, count(*) AS units FROM r GROUP BY ALL),
c AS (SELECT state_id, sector_id, subsector_id, industry_group_id, national_industry_id,
             sum(chars) AS production, count(tipo_vial) AS hours FROM r WHERE per_ocu IS NULL GROUP BY ALL)
SELECT u.*, CAST(production AS BIGINT) AS production, hours, {R6('1000.0 * production / nullif(hours, 0)')} AS productivity
FROM u LEFT JOIN c USING (state_id, sector_id, subsector_id, industry_group_id, national_industry_id)
""")
def j3_five_keys_left(spark, sf_dir):
    """J3 with Q1, Q2, P11, P12: six-digit activities with their hierarchy,
    left-joined on state and four code levels to the census rows without a
    stratum; an activity the census lacks keeps missing values."""
    r = registry(spark, sf_dir).where(F.length("codigo_act") == 6)
    levels = {c: F.substring("codigo_act", 1, n) for c, n in _LEVELS.items()}
    r = r.withColumnsRenamed({"cve_ent": "state_id"}).withColumns(levels).withColumn("national_industry_id", F.col("codigo_act"))
    keys = ["state_id", *_LEVELS, "national_industry_id"]
    units = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"))
    census = r.where(F.col("per_ocu").isNull()).groupBy(*keys).agg(
        F.sum(F.length("raz_social")).alias("production"), F.count("tipo_vial").alias("hours"))
    out = J.join_keys(units, census, keys, "left")
    return out.withColumn("productivity", r6(R.safe_div(1000.0 * F.col("production"), F.col("hours"))))
