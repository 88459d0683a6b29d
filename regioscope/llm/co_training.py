"""Document quality by co-training.

Two classifiers look at separate views of a document:

* text: which words (and five-letter word beginnings) it holds, a sparse
  logistic regression;
* metadata and layout: language, source, length, lines, shares of capitals,
  digits, punctuation and distinct words, a random forest.

Both learn from labelled rows.  Then, for ``ROUNDS`` rounds, each labels the
rows of an unlabelled pool of which it is confident, and the other learns
from them.  On labelled rows kept apart each view's log odds are calibrated,
and the calibrated views, taken as independent given the class, are added
up to one score, the probability that the document is good.

A document is good where ``quality`` is 1 and ``toxic`` is not.  Labelled
rows and pool are samples of at most ``LABELLED`` and ``POOL`` rows, chosen by
a hash of the id; the vocabulary has at most ``VOCABULARY`` entries.  All
documents are scored, over their whole texts.

Null and empty texts have no words and are scored by what is left.  Labels
that are null, or contradict each other for one id, count as missing or bad.
With fewer than ``FEWEST`` rows of either class nothing can be learnt:
scores are null and every document is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import materialize

LABELLED, POOL, VOCABULARY, FEWEST = 20_000, 10_000, 1 << 15, 20
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 2, 0.98, 0.5
#: Documents below this score are rejected; less than half, as a text of a few
#: words says little and should not go for that.
CUT = 0.4
MEASURES = ("chars", "words", "lines", "distinct", "capitals", "digits", "marks", "long", "end")


def _hash_share(id_col: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("string"), F.lit(salt)), F.lit(1 << 30)) / (1 << 30)


def _without(text: Column, letters: str) -> Column:
    """Share of the characters that are among ``letters``."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, letters, ""))) / n).otherwise(0.0)


def with_views(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the inputs of both views under names that begin with ``_q_``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_q_{c}") if c in docs.columns
             else F.lit("").alias(f"_q_{c}") for c in ("lang", "source")]
    out = docs.select("*", text.alias("_q_text"), *named) \
        .withColumn("_q_all", F.array_remove(F.split(F.lower("_q_text"), r"\s+"), "")) \
        .withColumn("_q_each", F.array_distinct("_q_all"))
    begin = F.transform(F.filter("_q_each", lambda w: F.length(w) > 5),
                        lambda w: F.concat(F.lit("^"), F.substring(w, 1, 5)))
    n, u = F.size("_q_all"), F.size("_q_each")
    t = F.col("_q_text")
    measures = {
        "chars": F.log1p(F.length(t)), "words": F.log1p(n), "lines": F.log1p(F.size(F.split(t, "\n"))),
        "distinct": F.when(n > 0, F.log(u / n)).otherwise(0.0) / F.log1p(n + 1),
        "capitals": _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _without(t, "0123456789"),
        "marks": _without(t, "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"),
        "long": F.length(t) / F.greatest(n, F.lit(1)),
        "end": F.size(F.filter("_q_each", lambda w: F.right(w, F.lit(1)).isin("!", "%", "#", "$", "&", "*", "|")))
        / F.greatest(u, F.lit(1)),
    }
    return out.select("*", F.array_distinct(F.concat("_q_each", begin)).alias("_q_tokens"),
                      *(e.cast("double").alias(f"_q_{k}") for k, e in measures.items()))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _good(col: str) -> Column:
    return vector_to_array(F.col(col)).getItem(1)


@dataclass
class QualityModel:
    """Fitted views: vectorisers, classifiers, and for each view slope and
    intercept of its calibrated log odds; ``prior`` are the log odds of a
    good document."""
    prepare: PipelineModel
    text: object
    meta: object
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def add_scores(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with text_score, meta_score, score and kept (for the
        last two see the module)."""
        df = self.prepare.transform(with_views(docs, text_col))
        df = self.meta.transform(self.text.transform(df))
        (a, b), (c, d) = self.scales
        text, meta = F.lit(a) * _odds(_good("_q_tp")) + b, F.lit(c) * _odds(_good("_q_mp")) + d
        sigmoid = lambda x: 1 / (1 + F.exp(-x))
        df = df.select(*docs.columns, text.alias("_q_t"), meta.alias("_q_m"))
        return df.select(*docs.columns, sigmoid(F.col("_q_t")).alias("text_score"),
                         sigmoid(F.col("_q_m")).alias("meta_score"),
                         sigmoid(F.col("_q_t") + F.col("_q_m") - self.prior).alias("score")) \
            .withColumn("kept", F.col("score") >= CUT)


def _calibrate(odds: DataFrame, col: str) -> tuple[float, float]:
    rows = VectorAssembler(inputCols=[col], outputCol="x").transform(odds)
    m = LogisticRegression(featuresCol="x", labelCol="good", regParam=1e-3, maxIter=50).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fit both views and their combination; None where labels are too few."""
    good = F.when(F.col("quality").isNull() & ~F.coalesce(F.col("toxic") == 1, F.lit(False)), None) \
        .otherwise(((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("double"))
    known = materialize(labels.select(F.col(id_col).alias("_q_id"), good.alias("good")).where("good is not null")
                        .groupBy("_q_id").agg(F.min("good").alias("good")), "labels")
    n = max(known.count(), 1)
    some = known.where(_hash_share(F.col("_q_id"), "labelled") < LABELLED / n)
    everything = max(docs.count(), 1)
    own = F.col(id_col).alias("_q_id")
    texts = docs.select(own, F.col(text_col), *(c for c in ("lang", "source") if c in docs.columns and c != text_col))
    taught = texts.join(some, "_q_id")
    pool = texts.where(_hash_share(F.col("_q_id"), "pool") < POOL / everything).join(known, "_q_id", "left_anti") \
        .withColumn("good", F.lit(None).cast("double"))
    rows = with_views(taught.unionByName(pool), text_col).withColumn(
        "fold", _hash_share(F.col("_q_id"), "fold") < 0.25)
    rows = materialize(rows.select("_q_id", "good", "fold", "_q_lang", "_q_source", "_q_tokens",
                                   *(f"_q_{m}" for m in MEASURES)), "training-rows")
    sizes = {(r["good"], r["fold"]): r["n"] for r in
             rows.where("good is not null").groupBy("good", "fold").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((g, f), 0) for g in (0.0, 1.0) for f in (True, False)) < FEWEST // 4 or \
            min(sum(sizes.get((g, f), 0) for f in (True, False)) for g in (0.0, 1.0)) < FEWEST:
        return None
    learn = rows.where("good is not null and not fold")
    words = CountVectorizer(inputCol="_q_tokens", outputCol="_q_x", binary=True, minDF=5.0,
                            vocabSize=VOCABULARY).fit(learn)
    names = FeatureHasher(inputCols=["_q_lang", "_q_source"], outputCol="_q_names", numFeatures=64)
    layout = VectorAssembler(inputCols=["_q_names", *(f"_q_{m}" for m in MEASURES)], outputCol="_q_y")
    prepare = PipelineModel([words, names, layout])
    rows = materialize(prepare.transform(rows).select("_q_id", "good", "fold", "_q_x", "_q_y"), "training-vectors")
    learn = rows.where("good is not null and not fold").withColumn("weight", F.lit(1.0))
    pool = rows.where("good is null")
    text = LogisticRegression(featuresCol="_q_x", labelCol="good", weightCol="weight", elasticNetParam=1.0,
                              regParam=3e-4, maxIter=40, probabilityCol="_q_tp", rawPredictionCol="_q_tr",
                              predictionCol="_q_tl")
    meta = RandomForestClassifier(featuresCol="_q_y", labelCol="good", weightCol="weight", numTrees=20, maxDepth=7,
                                  seed=7, probabilityCol="_q_mp", rawPredictionCol="_q_mr", predictionCol="_q_ml")
    for_text, for_meta = learn, learn
    for turn in range(ROUNDS + 1):
        t, m = text.fit(for_text), meta.fit(for_meta)
        if turn == ROUNDS:
            break
        seen = m.transform(t.transform(pool)).select("_q_id", "fold", "_q_x", "_q_y", _good("_q_tp").alias("pt"),
                                                     _good("_q_mp").alias("pm"))

        def told(p: str) -> DataFrame:
            sure = (F.col(p) >= CONFIDENT) | (F.col(p) <= 1 - CONFIDENT)
            return seen.where(sure).select("_q_id", F.round(p).alias("good"), "fold", "_q_x", "_q_y",
                                           F.lit(PSEUDO_WEIGHT).alias("weight"))
        for_text, for_meta = (learn.unionByName(materialize(told(p), "pseudo-labels")) for p in ("pm", "pt"))
    apart = m.transform(t.transform(rows.where("good is not null and fold"))).select(
        "good", _odds(_good("_q_tp")).alias("ot"), _odds(_good("_q_mp")).alias("om"))
    apart = materialize(apart, "calibration")
    share = apart.agg(F.avg("good")).first()[0]
    prior = apart.select(_odds(F.lit(share)).alias("o")).first()[0]
    return QualityModel(prepare, t, m, (_calibrate(apart, "ot"), _calibrate(apart, "om")), prior)


def add_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text_score, meta_score, score and kept, by a model fitted
    on them and ``labels`` (id, quality, toxic).  Columns of these names in
    ``docs`` are replaced."""
    names = ("text_score", "meta_score", "score", "kept")
    model = fit(docs, labels, id_col, text_col)
    docs = docs.drop(*names)
    if model is None:
        return docs.select("*", *(F.lit(None).cast("double").alias(c) for c in names[:3]), F.lit(True).alias("kept"))
    return model.add_scores(docs, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    # score under names of our own, as docs may hold columns of these names
    plain = [F.col(c).alias(f"_d{i}") for i, c in enumerate(docs.columns)]
    extra = [F.col(c) for c in ("lang", "source") if c in docs.columns and c != text_col]
    if text_col in ("lang", "source"):
        raise ValueError("text_col must not be named lang or source")
    scored = model.add_scores(docs.select(*plain, F.col(text_col).alias("_text"), *extra), "_text")
    return scored.where("kept").select(*(F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)))
