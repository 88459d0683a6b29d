"""Model-side invariants."""

import math

from pyspark.sql import functions as F

from regioscope.operators import ml as ML


def test_binary_metrics_hand_computed(spark):
    # truth/estimate counts with class 0 as the event: tp=3 fp=1 fn=2 tn=4
    rows = [(0, 0)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(1, 1)] * 4
    df = spark.createDataFrame(rows, "y int, prediction int")
    m = {r["metric"]: r["estimate"] for r in ML.binary_metrics(df).collect()}
    assert math.isclose(m["accuracy"], 0.7) and math.isclose(m["sens"], 0.6)
    assert math.isclose(m["spec"], 0.8) and math.isclose(m["ppv"], 0.75)
    assert math.isclose(m["npv"], 4 / 6) and math.isclose(m["f_meas"], 2 * 0.75 * 0.6 / 1.35)
    pe = (4 * 5 + 6 * 5) / 100
    assert math.isclose(m["kap"], (0.7 - pe) / (1 - pe))
    assert math.isclose(m["mcc"], (12 - 2) / math.sqrt(4 * 5 * 5 * 6))
    assert len(m) == 13


def test_confusion_is_complete(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, prediction int")
    c = {(r["truth"], r["estimate"]): r["n"] for r in ML.confusion(df).collect()}
    assert c == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_pipeline_fit_score_coefficients(spark, tmp_path):
    from regioscope.plans import model as M
    model, data, train, test = M.fitted(spark, "/root/testdata/sf0.001")
    s = ML.score(model, data, keep=("id", "y"))
    assert s.count() == data.count()
    assert s.where((F.col("probability_1") < 0) | (F.col("probability_1") > 1)).count() == 0
    coefs = ML.coefficients(model, model.transform(data.limit(1)))
    names = [r["features"] for r in coefs.collect()]
    assert names[0] == "(Intercept)" and any("numericas" in n for n in names)
    from pyspark.ml import PipelineModel
    from regioscope.sources import io as IO
    IO.save_model(model, str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(data).count() == data.count()


def test_rformula_variant_fits(spark):
    from regioscope.plans import model as M
    _, train, _ = M.train_test(spark, "/root/testdata/sf0.001")
    model = ML.logistic_pipeline(formula=True).fit(train)
    assert model.transform(train).select("probability").count() == train.count()


def test_tune_by_f1_reports_every_grid_point(spark):
    from regioscope.plans import model as M
    _, train, _ = M.train_test(spark, "/root/testdata/sf0.001")
    cvm, metrics = ML.tune(train, reg_params=[0.0, 0.5], folds=2, parallelism=2, metric="f1")
    rows = metrics.collect()
    assert len(rows) == 2 and all(0 <= r["f1"] <= 1 for r in rows)
    assert ML.best_reg_param(cvm) in (0.0, 0.5)


def test_confusion_counts_sum_to_rows(spark):
    from regioscope.plans import model as M
    model, data, _, test = M.fitted(spark, "/root/testdata/sf0.001")
    c = ML.confusion(ML.score(model, test, keep=("id", "y")))
    assert sum(r["n"] for r in c.collect()) == test.count()


def test_a_category_of_k_levels_has_k_minus_one_dummies(spark):
    from regioscope.plans import model as M
    model, data, _, _ = M.fitted(spark, "/root/testdata/sf0.001")
    names = [r["features"] for r in ML.coefficients(model, model.transform(data.limit(1))).collect()]
    for c in ML.CATEGORICAL:
        k = data.select(c).distinct().count()
        assert sum(f"_{c}_onehot_" in n for n in names) == k - 1, c
    assert "numericas_razon_pr" in names and not any(n.endswith("_imp") for n in names)


def test_kmeans_keeps_rows_without_coordinates(spark):
    rows = [(float(i % 5), float(i % 3)) for i in range(20)] + [(None, 1.0)]
    out = ML.kmeans_clusters(spark.createDataFrame(rows, "latitud double, longitud double"), k=3).collect()
    assert len(out) == 21 and [r["cluster"] is None for r in out].count(True) == 1


def test_models_by_group_keep_and_explain_every_row(spark):
    from regioscope.plans import model as M
    data = M.labelled(spark, "/root/testdata/sf0.001").withColumn(
        "g", F.when(F.col("id") % 7 == 0, None).when(F.col("y") == 1, "mixed")
        .when(F.col("id") % 2 == 0, "mixed").otherwise("only zeros"))
    rows = M.models_by_group(data, "g", "state").collect()
    assert len(rows) == data.count()
    for r in rows:
        assert (r["probability_1"] is None) == (r["g"] != "mixed") == (r["reason"] is not None)


def test_two_dimensional_grid(spark):
    from regioscope.plans import model as M
    _, train, _ = M.train_test(spark, "/root/testdata/sf0.001")
    _, metrics = ML.tune(train, reg_params=[0.0, 0.1], elastic_net=[0.0, 0.5, 1.0], folds=2, metric="f1")
    assert metrics.count() == 6


def test_kmeans_by_hand(spark):
    """Two far groups and one point between: start, rounds and ties."""
    pts = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (10.0, 10.0), (10.0, 11.0), (4.0, 4.0), (float("nan"), 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, latitud double, longitud double")
    got = {r["id"]: r["cluster"] for r in ML.kmeans_clusters(df, k=2).collect()}
    assert got == {0: "0", 1: "0", 2: "0", 3: "1", 4: "1", 5: "0", 6: None}
    assert ML.kmeans_centers(df, ["latitud", "longitud"], 2, 20, 6) == [(1250000, 1250000), (10000000, 10500000)]
    same = spark.createDataFrame([(1, 2.0, 2.0)] * 3, "id int, latitud double, longitud double")
    assert {r["cluster"] for r in ML.kmeans_clusters(same, k=5).collect()} == {"0"}
    assert ML.kmeans_clusters(df.limit(0), k=3).collect() == []


def test_model_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    """One small file of many rows is one task of the scan, and was one of
    every pass of a fit."""
    from regioscope.plans import model as M
    spark.range(25_000).coalesce(1).selectExpr(
        "id AS c_custkey", "'n' AS c_name", "CAST(id % 5 AS INT) AS c_nationkey", "CAST(id % 9000 AS DOUBLE) AS c_acctbal",
        "'BUILDING' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(5).selectExpr("CAST(id AS INT) AS n_nationkey", "'X' || id AS n_name", "CAST(id % 2 AS INT) AS n_regionkey"
                              ).write.parquet(str(tmp_path / "nation.parquet"))
    data = M.labelled(spark, str(tmp_path))
    assert data.rdd.getNumPartitions() > 1
    assert data.count() == data.select("id").distinct().count() == 25_000
    assert data.inputFiles() != [] and not any("customer.parquet" in f for f in data.inputFiles())
