"""Unit fixtures for the R-semantics traps and the registry features."""

import math

from pyspark.sql import functions as F

from regioscope.functions import dates as D
from regioscope.functions import rsem as R
from regioscope.functions import text as X
from regioscope.operators import aggregates as A


def test_legal_form_leftmost_first(spark):
    names = ["GRUPO ACERO SA DE CV", "PRINCIPAL SA DE CV", "CASA CHICA SA DE CV",
             "INDUSTRIAS DE CV", "FOO S A P I DE CV", "JUAN PEREZ", "BANCO X SA DE CV SOFOM ENR",
             "TALLER, S.A. DE C.V."]
    df = spark.createDataFrame([(n,) for n in names], "raz string")
    got = dict(df.select("raz", X.legal_form("raz").alias("r")).collect())
    assert got["GRUPO ACERO SA DE CV"] == "AC"          # ' AC' inside ACERO, squished
    assert got["PRINCIPAL SA DE CV"] == "INC"
    assert got["CASA CHICA SA DE CV"] == "AC"           # 'A C' normalised to AC
    assert got["INDUSTRIAS DE CV"] == "S DE CV"
    assert got["FOO S A P I DE CV"] == "SAPI DE CV"
    assert got["JUAN PEREZ"] == X.NO_LEGAL_FORM
    assert got["TALLER, S.A. DE C.V."] == "SA DE CV"


def test_legal_form_dummies_and_size_target(spark):
    df = spark.createDataFrame([("SA DE CV SOFOM ENR", "0 a 5 personas"),
                                ("SPR DE RL", "31 a 50 personas"),
                                ("AC", None)], "razon string, per_ocu string")
    cols = X.legal_form_dummies("razon")
    rows = df.select(*[c.alias(k) for k, c in cols.items()],
                     X.size_target("per_ocu").alias("t")).collect()
    assert rows[0]["razon_sofom"] == 1.0 and rows[0]["razon_sa"] == 1.0
    assert rows[1]["razon_pr"] == 1.0 and rows[1]["razon_spr"] == 1.0
    assert rows[0]["t"] == X.SIZE_LABELS[0]
    assert rows[1]["t"] == X.SIZE_LABELS[1]
    assert rows[2]["t"] == X.SIZE_LABELS[1]              # NA size class -> positive


def test_dates_and_safe_ops(spark):
    df = spark.createDataFrame([("2022-11", 1.0, 0.0), ("2022-13", 2.0, 1.0), (None, None, 2.0)],
                               "d string, a double, b double")
    r = df.select(D.ym("d").alias("ym"), D.months_open(D.ym("d")).alias("mo"),
                  R.safe_div("a", "b").alias("q"), R.r_in("d", ["2022-11"]).alias("i")).collect()
    assert r[0]["mo"] == 0.0 and r[1]["ym"] is None and r[1]["mo"] is None
    assert r[0]["q"] is None and r[1]["q"] == 2.0
    assert r[2]["i"] is False                          # NULL %in% -> FALSE


def test_period_from_path(spark):
    df = spark.createDataFrame([("/data/raw/registry/0519_registry.csv",), ("/x/no_digits.csv",)], "p string")
    r = df.select(D.period_from_path("p").alias("d")).collect()
    assert str(r[0]["d"]) == "2019-05-01" and r[1]["d"] is None


def test_replace_first_and_extract(spark):
    df = spark.createDataFrame([("a_b_c",)], "s string")
    r = df.select(X.replace_first("s", "_", " ").alias("f"), X.extract("s", "z").alias("e"),
                  X.squish(F.lit("  a   b ")).alias("q")).first()
    assert r["f"] == "a b_c" and r["e"] is None and r["q"] == "a b"


def test_r_mean_and_repair(spark):
    df = spark.createDataFrame([("one", 0.5), ("allnull", None), ("part", 0.2), ("part", None),
                                ("nan", float("nan")), ("ok", 0.2), ("ok", 0.4)], "g string, q double")
    g = A.group_stats(df, ["g"], "q")
    rep = {r["g"]: r for r in A.cohort_potential(g).collect()}
    assert rep["one"]["std_dev"] is None and rep["one"]["n"] == 1      # sd of one row is NA
    assert rep["allnull"]["n"] == 0 and rep["allnull"]["quality_index"] == 0.0
    assert rep["part"]["n"] == 0                                       # any NA -> NA mean
    assert rep["nan"]["n"] == 0 and rep["nan"]["quality_index"] == 0.0
    assert math.isclose(rep["ok"]["cohort_potential"], 0.6)


def test_clean_names_and_ranges(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Año Base` int, tipoUniEco int, `a b` int, a_b int")
    c = R.clean_names(df).columns
    assert c == ["ano_base", "tipo_uni_eco", "a_b", "a_b_2"]
    assert R.cols_between(df, "tipoUniEco", "a_b") == ["tipoUniEco", "a b", "a_b"]


def test_ids_stay_strings(spark, tmp_path):
    p = tmp_path / "ids.csv"
    p.write_text("cve_ent,v\n01,1\n09,2\n")
    from regioscope.sources import io as IO
    df = IO.read_csv(spark, str(p), "cve_ent string, v double")
    assert sorted(r[0] for r in df.collect()) == ["01", "09"]


def test_value_map_cap_na_level(spark):
    df = spark.createDataFrame([("Coahuila de Zaragoza", 0.7), ("Jalisco", 0.2), (None, None)],
                               "state string, q double")
    m = {"Coahuila de Zaragoza": "Coahuila", "Michoacán de Ocampo": "Michoacán"}
    r = df.select(R.value_map("state", m).alias("s"), R.cap("q", 0.5).alias("c"),
                  R.with_na_level("state").alias("f")).collect()
    assert [x["s"] for x in r] == ["Coahuila", "Jalisco", None]
    assert [x["c"] for x in r] == [0.5, 0.2, None]
    assert r[2]["f"] == "<NA>"


def test_json_cube_reader(spark, tmp_path):
    from regioscope.sources import io as IO
    p = tmp_path / "cube.json"
    p.write_text('{"data": [{"State": "Coahuila de Zaragoza", "ECI Ranking": 3, "ECI": 1.5},\n'
                 '          {"State": "Jalisco", "ECI Ranking": 5, "ECI": 0.7}]}')
    df = IO.read_json_cube(spark, str(p), "State string, `ECI Ranking` long, ECI double")
    df = R.clean_names(df)
    assert df.columns == ["state", "eci_ranking", "eci"]
    assert sorted(r["eci_ranking"] for r in df.collect()) == [3, 5]


def test_bulk_casts_and_rounding(spark):
    df = spark.createDataFrame([("1.5", True, 0.125), ("x", False, 2.675)], "a string, b boolean, c double")
    out = R.round_numeric(R.logical_to_double(R.cast_all(df, ["a"])), 2).collect()
    assert out[0]["a"] == 1.5 and out[1]["a"] is None          # bad text -> NULL, no error
    assert out[0]["b"] == 1.0 and out[1]["b"] == 0.0
    assert out[0]["c"] == 0.13 and out[1]["c"] == 2.68         # half-up on the decimal value
    assert R.numeric_columns(df) == ["c"]
