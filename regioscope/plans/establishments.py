"""Product B, data side: registry clean-up and model features.

One row per establishment in, one row out: every step is a projection, so
the plan is a single scan + broadcast-dimension join + codegen'd project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.functions import dates as D
from regioscope.functions import rsem as R
from regioscope.functions import text as X
from regioscope.operators import aggregates as A
from regioscope.plans.bindings import NAME_TAILS, ROAD_TYPES, SIZE_CLASSES, registry, r6
from regioscope.plans.registry import R6, query


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# DuckDB twin of bindings.registry
REGISTRY_SQL = f"""
registry AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
    CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS nom_estab,
    concat_ws(' ', c_name, {_sql_list(NAME_TAILS)}[c_custkey % 15 + 1]) AS raz_social,
    '46' || lpad(CAST(c_custkey % 97 AS VARCHAR), 4, '0') AS codigo_act,
    CASE WHEN c_custkey % 11 <> 0 THEN
      {_sql_list(SIZE_CLASSES)}[CAST(floor(abs(c_acctbal) / 1500) AS BIGINT) % 7 + 1] END AS per_ocu,
    CASE WHEN c_custkey % 9 <> 0 THEN {_sql_list(ROAD_TYPES)}[c_custkey % 5 + 1] END AS tipo_vial,
    CASE WHEN c_custkey % 3 = 0 THEN 'EDIFICIO ' || CAST(c_custkey AS VARCHAR) END AS edificio,
    CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS tipo_asent,
    lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS cve_ent,
    lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS cve_mun,
    n_name AS municipio,
    CASE WHEN c_custkey % 4 <> 0 THEN '55' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS telefono,
    CASE WHEN c_custkey % 6 <> 0 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@mail.mx' END AS correoelec,
    CASE WHEN c_custkey % 8 = 0 THEN 'www.c' || CAST(c_custkey AS VARCHAR) || '.mx' END AS www,
    CASE WHEN c_custkey % 10 = 0 THEN 'Semifijo' ELSE 'Fijo' END AS "tipoUniEco",
    CAST(c_custkey % 13 + 2010 AS VARCHAR) || '-' || lpad(CAST(c_custkey % 13 + 1 AS VARCHAR), 2, '0') AS fecha_alta,
    CAST(19.10 AS DOUBLE) + ((c_custkey * 91) % 1000) * CAST(0.00045 AS DOUBLE) AS latitud,
    CAST(-99.36 AS DOUBLE) + ((c_custkey * 37) % 1000) * CAST(0.0004 AS DOUBLE) AS longitud
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
"""


def _sql_legal_form(col: str) -> str:
    pat = X.LEGAL_FORM_PATTERN.replace("'", "''")
    cleaned = f"regexp_replace({col}, '[\\.,]+', '', 'g')"
    ext = f"nullif(regexp_extract({cleaned}, '{pat}'), '')"
    sq = f"trim(regexp_replace({ext}, '\\s+', ' ', 'g'))"
    r1 = f"regexp_replace({sq}, 'A C$', 'AC')"
    r2 = f"regexp_replace({r1}, 'S A P I', 'SAPI')"
    return f"coalesce({r2}, '{X.NO_LEGAL_FORM}')"


def _sql_in(col: str, values) -> str:
    return f"coalesce({col} IN ({', '.join(repr(v) for v in values)}), false)"


def model_input(reg: DataFrame) -> DataFrame:
    """The registry prep: target, name length, activity code, fills,
    presence flags, start year / month, months open, legal-form dummies.
    Keys ``id, cve_ent, cve_mun`` are kept through."""
    name = F.coalesce("nom_estab", "raz_social")
    reg = reg.withColumn("razon", X.legal_form("raz_social"))
    start = D.ym("fecha_alta")
    cols = {
        "id": F.col("id"), "cve_ent": F.col("cve_ent"), "cve_mun": F.col("cve_mun"),
        "employees_30_or_more": X.size_target("per_ocu"),
        "length_name": F.length(name),
        "codigo_act": X.extract("codigo_act", r"^\d{6}"),
        "tipo_vial": F.coalesce("tipo_vial", F.lit("Sin vialidad")),
        "edificio": R.present("edificio"),
        "tipo_asent": F.coalesce("tipo_asent", F.lit("Sin asentamiento")),
        "municipio": F.col("municipio"),
        "telefono": R.present("telefono"),
        "correo_electronico": R.present("correoelec"),
        "pagina_web": R.present("www"),
        "tipoUniEco": F.col("tipoUniEco"),
        "year_alta": F.year(start),
        "month_alta": F.month(start),
        "month_open": D.months_open(start),
        "razon": F.col("razon"),
    }
    cols.update(X.legal_form_dummies("razon"))
    cols["latitud"], cols["longitud"] = F.col("latitud"), F.col("longitud")
    return reg.select(*[c.alias(k) for k, c in cols.items()])


MODEL_INPUT_SQL = "WITH " + REGISTRY_SQL + f""",
r1 AS (SELECT *, {_sql_legal_form('raz_social')} AS razon,
              CAST(try_strptime(fecha_alta, '%Y-%m') AS DATE) AS start FROM registry),
model_input AS (
  SELECT id, cve_ent, cve_mun,
    CASE WHEN {_sql_in('per_ocu', X.SMALL_SIZE_CLASSES)} THEN '{X.SIZE_LABELS[0]}'
         ELSE '{X.SIZE_LABELS[1]}' END AS employees_30_or_more,
    CAST(length(coalesce(nom_estab, raz_social)) AS INTEGER) AS length_name,
    nullif(regexp_extract(codigo_act, '^\\d{{6}}'), '') AS codigo_act,
    coalesce(tipo_vial, 'Sin vialidad') AS tipo_vial,
    CAST(edificio IS NOT NULL AS DOUBLE) AS edificio,
    coalesce(tipo_asent, 'Sin asentamiento') AS tipo_asent,
    municipio,
    CAST(telefono IS NOT NULL AS DOUBLE) AS telefono,
    CAST(correoelec IS NOT NULL AS DOUBLE) AS correo_electronico,
    CAST(www IS NOT NULL AS DOUBLE) AS pagina_web,
    "tipoUniEco",
    CAST(year(start) AS INTEGER) AS year_alta, CAST(month(start) AS INTEGER) AS month_alta,
    date_diff('day', start, DATE '2022-11-01') / 30.0 AS month_open,
    razon,
    {", ".join(f"CAST(regexp_matches(razon, '{code}') AS DOUBLE) AS {name}" for name, code in X.LEGAL_FORM_CODES)},
    latitud, longitud
  FROM r1)
"""


@query("p9_model_input", sql=MODEL_INPUT_SQL + f"""
SELECT * REPLACE ({R6('month_open')} AS month_open, {R6('latitud')} AS latitud,
                  {R6('longitud')} AS longitud)
FROM model_input
""")
def p9_model_input(spark, sf_dir):
    """The whole model-input table."""
    m = model_input(registry(spark, sf_dir))
    return m.withColumns({"month_open": r6("month_open"), "latitud": r6("latitud"),
                          "longitud": r6("longitud")})


@query("f19_legal_form", sql="WITH " + REGISTRY_SQL + f"""
SELECT id, raz_social, {_sql_legal_form('raz_social')} AS razon FROM registry
""")
def f19_legal_form(spark, sf_dir):
    reg = registry(spark, sf_dir)
    return reg.select("id", "raz_social", X.legal_form("raz_social").alias("razon"))


@query("a9_size_frequency", sql=MODEL_INPUT_SQL + """
, f AS (SELECT employees_30_or_more, count(*) AS n FROM model_input GROUP BY 1)
SELECT employees_30_or_more, CAST(n AS BIGINT) AS n,
       CAST((SELECT min(n) FROM f) AS BIGINT) AS minority FROM f
""")
def a9_size_frequency(spark, sf_dir):
    """Frequency of the size target plus the minority-class size."""
    m = model_input(registry(spark, sf_dir))
    f = A.frequency(m, "employees_30_or_more")
    return f.withColumn("minority", f.select(F.min("n")).scalar())


@query("f14_dates", sql="WITH " + REGISTRY_SQL + f"""
, d AS (SELECT id, fecha_alta, CAST(try_strptime(fecha_alta, '%Y-%m') AS DATE) AS start
        FROM registry)
SELECT id, start, CAST(year(start) AS INTEGER) AS year_alta,
       CAST(month(start) AS INTEGER) AS month_alta,
       {R6("date_diff('day', start, DATE '2022-11-01') / 30.0")} AS month_open
FROM d
""")
def f14_dates(spark, sf_dir):
    reg = registry(spark, sf_dir)
    start = D.ym("fecha_alta")
    return reg.select("id", start.alias("start"), F.year(start).alias("year_alta"),
                      F.month(start).alias("month_alta"),
                      r6(D.months_open(start)).alias("month_open"))


@query("p12_code_levels", sql="WITH " + REGISTRY_SQL + """
SELECT id, codigo_act,
  nullif(regexp_extract(codigo_act, '\\d{2}'), '') AS sector_id,
  nullif(regexp_extract(codigo_act, '\\d{3}'), '') AS subsector_id,
  nullif(regexp_extract(codigo_act, '\\d{4}'), '') AS industry_group_id,
  nullif(regexp_extract(codigo_act, '\\d{5}'), '') AS naics_industry_id
FROM registry WHERE length(codigo_act) = 6 AND nom_estab IS NOT NULL
""")
def p12_code_levels(spark, sf_dir):
    """Q1 + Q2 filters, then the 6-digit activity code split into levels."""
    reg = registry(spark, sf_dir).where((F.length("codigo_act") == 6)
                                        & F.col("nom_estab").isNotNull())
    return reg.select("id", "codigo_act",
                      *[X.extract("codigo_act", r"\d{%d}" % k).alias(n) for k, n in
                        [(2, "sector_id"), (3, "subsector_id"), (4, "industry_group_id"),
                         (5, "naics_industry_id")]])


@query("p1_clean_names", sql="WITH " + REGISTRY_SQL + """
SELECT id, "tipoUniEco" AS tipo_uni_eco, nom_estab, correoelec FROM registry
""")
def p1_clean_names(spark, sf_dir):
    """snake_case column names (``tipoUniEco`` -> ``tipo_uni_eco``)."""
    reg = R.clean_names(registry(spark, sf_dir))
    return reg.select("id", "tipo_uni_eco", "nom_estab", "correoelec")


@query("q5_regex_filter", sql=MODEL_INPUT_SQL + """
SELECT id, razon FROM model_input
WHERE regexp_matches(razon, 'CV') AND NOT regexp_matches(razon, 'SOFOM')
""")
def q5_regex_filter(spark, sf_dir):
    """Include / exclude regex filter pair."""
    m = model_input(registry(spark, sf_dir))
    return m.where(X.detect("razon", "CV") & ~X.detect("razon", "SOFOM")).select("id", "razon")


@query("q3_in_list", sql=MODEL_INPUT_SQL + """
SELECT id, cve_ent FROM model_input WHERE coalesce(cve_ent IN ('01', '03'), false)
""")
def q3_in_list(spark, sf_dir):
    """``%in%`` on a zero-padded string id (no numeric inference)."""
    m = model_input(registry(spark, sf_dir))
    return m.where(R.r_in("cve_ent", ["01", "03"])).select("id", "cve_ent")
