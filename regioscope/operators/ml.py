"""Establishment-quality model (product B) on ``pyspark.ml``.

Feature stages (indexers, one-hot, assemblers) and the logistic regression
are one ``Pipeline``; tuning is ``CrossValidator``; scores come from
``transform``; evaluation is a handful of conditional sums, never a
collect of the scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioscope.functions.rsem import safe_div

# The feature names of the reference's three models.  State
# models use neither municipality nor months open, period models no
# municipality.
CATEGORICAL = ["tipo_vial", "tipo_asent", "municipio", "tipoUniEco", "codigo_act"]
NUMERIC = ["length_name", "edificio", "telefono", "correo_electronico", "year_alta",
           "month_alta", "month_open", "razon_cv", "razon_rl", "razon_ac", "razon_sapi",
           "razon_sab", "razon_pr", "razon_sofom", "razon_sfp", "razon_scl", "razon_spr",
           "razon_sc", "razon_inc", "razon_sas", "razon_sofi"]

FEATURE_SETS = {
    "city": (CATEGORICAL, NUMERIC),
    "state": ([c for c in CATEGORICAL if c != "municipio"], [c for c in NUMERIC if c != "month_open"]),
    "period": ([c for c in CATEGORICAL if c != "municipio"], NUMERIC),
}


def feature_stages(categorical: Sequence[str] = CATEGORICAL,
                   numeric: Sequence[str] = NUMERIC, handle_invalid: str = "error",
                   scale: bool = False) -> list:
    """Indexers -> one-hot -> two assemblers (``one_hot`` block,
    ``numericas`` block) -> ``features``.

    A category of k levels gives k - 1 dummies: its rarest level is
    dropped.  The stages are therefore fitted on all rows that will be scored
    (see ``fit_logistic``).  With ``handle_invalid='keep'`` levels that the
    fit has not seen are scored, as rows without a dummy; every level then
    keeps its dummy.  Missing numeric values (e.g. an unparsable start month)
    are imputed with the mean; numeric inputs must be doubles (see
    ``numeric_doubles``)."""
    idx = [f"{c}_index" for c in categorical]
    oh = [f"{c}_onehot" for c in categorical]
    imp = [f"{c}_imp" for c in numeric]
    stages = [StringIndexer(inputCols=list(categorical), outputCols=idx,
                            handleInvalid=handle_invalid),
              OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True),
              VectorAssembler(inputCols=oh, outputCol="one_hot"),
              Imputer(inputCols=list(numeric), outputCols=imp, strategy="mean"),
              VectorAssembler(inputCols=imp, outputCol="numericas")]
    blocks = ["numericas", "one_hot"]
    if scale:
        stages.append(StandardScaler(inputCol="numericas", outputCol="numericas_scaled"))
        blocks = ["numericas_scaled", "one_hot"]
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    return stages


def numeric_doubles(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """Cast the numeric feature columns to double (Imputer input)."""
    return df.withColumns({c: F.col(c).cast("double") for c in numeric})


def logistic_pipeline(reg_param: float = 0.0, elastic_net: float = 0.0,
                      label: str = "y", formula: bool = False, **kw) -> Pipeline:
    """Feature stages + logistic regression.  ``formula=True`` assembles
    the design with ``RFormula('<label> ~ numericas + one_hot')`` instead
    of the last assembler (the reference's ``ft_r_formula``)."""
    stages = feature_stages(**kw)
    if formula:
        from pyspark.ml.feature import RFormula
        stages = stages[:-1] + [RFormula(formula=f"{label} ~ numericas + one_hot",
                                         featuresCol="features", labelCol="_label")]
        label = "_label"
    lr = LogisticRegression(featuresCol="features", labelCol=label,
                            regParam=reg_param, elasticNetParam=elastic_net)
    return Pipeline(stages=stages + [lr])


def fit_logistic(train: DataFrame, every: DataFrame | None = None, reg_param: float = 0.0,
                 elastic_net: float = 0.0, label: str = "y", **kw) -> PipelineModel:
    """Feature stages fitted on ``every`` row to be scored (default: the
    training rows), the regression on ``train``; one model."""
    features = Pipeline(stages=feature_stages(**kw)).fit(train if every is None else every)
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg_param,
                            elasticNetParam=elastic_net)
    return PipelineModel([*features.stages, lr.fit(features.transform(train))])


def tune(train: DataFrame, reg_params: Sequence[float] | None = None,
         elastic_net: float | Sequence[float] = 1.0, folds: int = 10, parallelism: int = 8,
         metric: str = "areaUnderROC", seed: int = 123, label: str = "y"):
    """Grid + k-fold CV.  Defaults are the reference's: 100 regularisation
    values in [0, 1], lasso mixing, 10 folds, 8 parallel fits.  Several
    ``elastic_net`` values make the grid two-dimensional.  ``metric``
    ``'f1'`` uses the multiclass evaluator.  The features are fitted once and
    kept for the time of the search; only the regression is fitted again
    for each point and fold.  Returns ``(cv_model, metrics_df)`` with one row
    per grid point."""
    if reg_params is None:
        reg_params = list(np.linspace(0.0, 1.0, 100))
    mixes = [float(elastic_net)] if isinstance(elastic_net, (int, float)) else [float(v) for v in elastic_net]
    features = Pipeline(stages=feature_stages()).fit(train)
    rows = features.transform(train).select(label, "features").persist()
    lr = LogisticRegression(featuresCol="features", labelCol=label)
    grid = (ParamGridBuilder().addGrid(lr.regParam, [float(v) for v in reg_params])
            .addGrid(lr.elasticNetParam, mixes).build())
    if metric == "f1":
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    else:
        ev = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev,
                        numFolds=folds, parallelism=parallelism, seed=seed)
    model = cv.fit(rows)
    rows.unpersist()
    points = [(float(pm[lr.regParam]), float(pm[lr.elasticNetParam]), float(m))
            for pm, m in zip(grid, model.avgMetrics)]
    spark = train.sparkSession
    metrics = spark.createDataFrame(points, f"reg_param double, elastic_net_param double, {metric} double")
    return model, metrics


def best_reg_param(cv_model) -> float:
    return float(cv_model.bestModel.getRegParam())


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """``prediction``, ``probability_0``, ``probability_1`` per row."""
    p = model.transform(df)
    arr = vector_to_array("probability")
    return p.select(*keep, "prediction", arr[0].alias("probability_0"),
                    arr[1].alias("probability_1"))


def confusion(df: DataFrame, truth: str = "y", estimate: str = "prediction") -> DataFrame:
    """Complete 2 x 2 confusion table ``(truth, estimate, n)``."""
    cells = df.groupBy(F.col(truth).cast("int").alias("truth"),
                       F.col(estimate).cast("int").alias("estimate")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(t, e) for t in (0, 1) for e in (0, 1)],
                                           "truth int, estimate int")
    return grid.join(cells, ["truth", "estimate"], "left").fillna(0, ["n"])


METRICS = ["accuracy", "kap", "sens", "spec", "ppv", "npv", "mcc", "j_index",
           "bal_accuracy", "detection_prevalence", "precision", "recall", "f_meas"]


def binary_metrics(df: DataFrame, truth: str = "y", estimate: str = "prediction",
                   event_level: str = "first", by: Sequence[str] = ()) -> DataFrame:
    """The 13 summary metrics of a 2 x 2 confusion matrix, long format
    ``(by..., metric, estimate)``.  With ``event_level='first'`` class 0 is
    the event (positive) class.  Zero denominators give NULL."""
    ev = 0 if event_level == "first" else 1
    t = F.col(truth).cast("int") == ev
    e = F.col(estimate).cast("int") == ev
    c = df.groupBy(*by).agg(
        F.sum((t & e).cast("double")).alias("tp"), F.sum((~t & e).cast("double")).alias("fp"),
        F.sum((t & ~e).cast("double")).alias("fn"), F.sum((~t & ~e).cast("double")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sens = safe_div(tp, tp + fn)
    spec = safe_div(tn, tn + fp)
    prec = safe_div(tp, tp + fp)
    po = safe_div(tp + tn, n)
    pe = safe_div((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    m = {
        "accuracy": po,
        "kap": safe_div(po - pe, 1 - pe),
        "sens": sens, "spec": spec, "ppv": prec, "npv": safe_div(tn, tn + fn),
        "mcc": safe_div(tp * tn - fp * fn,
                        F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "j_index": sens + spec - 1,
        "bal_accuracy": (sens + spec) / 2,
        "detection_prevalence": safe_div(tp + fp, n),
        "precision": prec, "recall": sens,
        "f_meas": safe_div(2 * prec * sens, prec + sens),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("estimate"))
                    for k, v in m.items()])
    return c.select(*by, F.inline(arr))


def coefficients(model: PipelineModel, featurized: DataFrame) -> DataFrame:
    """``(features, coefficients)`` with the intercept first; names come
    from the assembled vector's attribute metadata."""
    lr = model.stages[-1]
    meta = featurized.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            # the imputed copy of a column stands for the column
            names[a["idx"]] = a["name"].removesuffix("_imp")
    coef = lr.coefficients.toArray()
    rows = [("(Intercept)", float(lr.intercept))] + \
        [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(coef)]
    return featurized.sparkSession.createDataFrame(rows, "features string, coefficients double")


def odds_table(coefs: DataFrame) -> DataFrame:
    """Odds multipliers of the numeric block, ``_cv`` terms excluded,
    names cleaned (``numericas_`` removed, ``_`` -> space), sorted."""
    from regioscope.functions import text as X
    c = coefs.where(X.detect("features", "numericas") & ~X.detect("features", "_cv"))
    c = c.withColumn("features", X.remove_all("features", "numericas_"))
    c = c.withColumn("features", F.regexp_replace("features", "_", " "))
    return c.withColumn("odds", F.exp("coefficients")).orderBy("odds")


def kmeans_centers(df: DataFrame, cols: Sequence[str], k: int, rounds: int, digits: int) -> list[tuple[int, ...]]:
    """Centres of ``k`` clusters, in units of the last digit.

    Farthest-first start: the smallest point, then again and again the point
    farthest from all centres so far (ties: the smallest).  Every round is one
    aggregate of exact integer sums, so the result does not depend on the
    order of rows; it ends early once no centre moves."""
    unit = 10 ** digits
    at = [f"try_cast(round(`{c}` * {unit}) AS BIGINT)" for c in cols]  # NaN is missing
    pts = df.selectExpr(*(f"{e} AS x{i}" for i, e in enumerate(at))).where(
        " AND ".join(f"x{i} IS NOT NULL" for i in range(len(cols))))
    xs = [f"x{i}" for i in range(len(cols))]
    first = pts.selectExpr(f"min(struct({', '.join(xs)})) AS p").first()["p"]
    centers = [tuple(first)] if first is not None else []
    while centers and len(centers) < k:
        away = f"least({', '.join([_square(xs, c) for c in centers] * (2 if len(centers) == 1 else 1))})"
        d, *p = pts.selectExpr(f"max(struct({away} AS d, {', '.join(f'-{x} AS m{x}' for x in xs)})) AS p").first()["p"]
        if not d:
            break  # fewer points than clusters
        centers.append(tuple(-v for v in p))
    for _ in range(rounds if centers else 0):
        sums = pts.selectExpr(f"{_nearest(xs, centers)} AS cl", *xs).groupBy("cl").agg(
            F.expr("count(*) AS n"), *(F.expr(f"sum({x}) AS {x}") for x in xs)).collect()
        moved = list(centers)
        for r in sums:  # at most k rows; rounded half up
            moved[r["cl"]] = tuple((2 * r[x] + r["n"]) // (2 * r["n"]) for x in xs)
        if moved == centers:
            break
        centers = moved
    return centers


def _square(xs: Sequence[str], center: Sequence[int]) -> str:
    return "(" + " + ".join(f"({x} - {c}L) * ({x} - {c}L)" for x, c in zip(xs, center)) + ")"


def _nearest(xs: Sequence[str], centers: Sequence[Sequence[int]]) -> str:
    """Number of the nearest centre; ties go to the smaller one."""
    return f"array_min(array({', '.join(f'struct({_square(xs, c)} AS d, {i} AS cl)' for i, c in enumerate(centers))})).cl"


def kmeans_clusters(df: DataFrame, cols: Sequence[str] = ("latitud", "longitud"), k: int = 10,
                    rounds: int = 20, digits: int = 6, out: str = "cluster") -> DataFrame:
    """K-means on coordinates (rounded to ``digits`` places); the cluster id
    is returned as a string, ready to be indexed and one-hot encoded like any
    other category.  Rows with a missing coordinate are kept, with a NULL
    cluster, and not fitted on."""
    unit = 10 ** digits
    centers = kmeans_centers(df, cols, k, rounds, digits)
    if not centers:
        return df.withColumn(out, F.lit(None).cast("string"))
    xs = [f"_x{i}" for i in range(len(cols))]
    placed = df.withColumns({x: F.expr(f"try_cast(round(`{c}` * {unit}) AS BIGINT)") for x, c in zip(xs, cols)})
    known = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    return placed.withColumn(out, F.expr(f"CASE WHEN {known} THEN CAST({_nearest(xs, centers)} AS STRING) END")).drop(*xs)
