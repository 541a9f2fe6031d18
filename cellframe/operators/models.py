"""Models of cell tables: fits by MLlib, scores as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import linear_score, sigmoid
from .curves import location_and_scale
from .ranks import quantiles

COEFFICIENTS = "feature string, coef_standardized double, coef_raw_units double, mean_used_for_standardizing double, scale_used_for_standardizing double"


def balanced(rows: DataFrame, label: str, features: list[str]) -> tuple[DataFrame, int]:
    """Complete rows with ``weight``, ``n / (2 * class size)``, and their number; both classes must be there."""
    whole = rows.dropna(subset=[label, *features])
    sizes = {int(r[0]): r[1] for r in whole.groupBy(F.col(label).cast("int")).count().collect()}  # two rows
    if set(sizes) != {0, 1}:
        raise ValueError(f"training rows need both classes, found {sorted(sizes)}")
    n = sum(sizes.values())
    weight = F.when(F.col(label) == 1, n / (2 * sizes[1])).otherwise(n / (2 * sizes[0]))
    return whole.withColumn("weight", weight), n


@dataclass(frozen=True)
class Logistic:
    features: list[str]
    location: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float

    def raw(self) -> tuple[dict[str, float], float]:
        """Weights and intercept in the features' own units."""
        weights = [w / s for w, s in zip(self.weights, self.scale, strict=True)]
        return dict(zip(self.features, weights, strict=True)), self.intercept - sum(w * m for w, m in zip(weights, self.location, strict=True))

    def eta(self) -> Column:
        """The logit of a row: an expression that stays in the JVM."""
        return linear_score(*self.raw())


def logistic(rows: DataFrame, label: str, features: list[str], c: float = 1.0) -> Logistic:
    """Standardised logistic regression with balanced weights; the penalty is that of ``c`` over the number of rows."""
    train, n = balanced(rows, label, features)
    known = {r.feature: r for r in location_and_scale(train, features).collect()}  # a row for each feature
    scaled = train.select(F.col(label).cast("double").alias("y"), "weight", *[((F.col(f) - known[f].location) / known[f].scale).alias(f) for f in features])
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(scaled)
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1 / (c * n), standardization=False, tol=1e-10, maxIter=500).fit(vectors)
    return Logistic(features, [known[f].location for f in features], [known[f].scale for f in features], fit.coefficients.toArray().tolist(), float(fit.intercept))


def coefficients(rows: DataFrame, model: Logistic) -> DataFrame:
    """The coefficient table: a row for each feature, and the intercept."""
    raw, intercept = model.raw()
    table = [(f, w, raw[f], m, s) for f, w, m, s in zip(model.features, model.weights, model.location, model.scale, strict=True)]
    return rows.sparkSession.createDataFrame([*table, ("intercept", model.intercept, intercept, None, None)], COEFFICIENTS)


def scored(rows: DataFrame, model: Logistic, cut: float = 0.5) -> DataFrame:
    """``rows`` with ``logit``, ``prob_source`` and ``pred_source``; NULL where a feature is missing."""
    out = rows.withColumn("logit", model.eta()).withColumn("prob_source", sigmoid("logit"))
    return out.withColumn("pred_source", (F.col("prob_source") >= float(cut)).cast("int"))


def forest(rows: DataFrame, label: str, features: list[str], trees: int = 300, depth: int = 30, seed: int = 42) -> RandomForestClassificationModel:
    """A random forest with balanced weights; depth 30 is MLlib's largest."""
    train, _ = balanced(rows, label, features)
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(train.withColumn("y", F.col(label).cast("double")))
    return RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(vectors.select("x", "y", "weight"))


def forest_scored(rows: DataFrame, model: RandomForestClassificationModel, features: list[str], cut: float = 0.5) -> DataFrame:
    """Complete rows with ``prob_source`` and ``pred_source``."""
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.dropna(subset=features))
    model = model.copy().setFeaturesCol("_x").setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_p")
    out = model.transform(vectors).withColumn("prob_source", vector_to_array("_p")[1]).drop("_x", "_p")
    return out.withColumn("pred_source", (F.col("prob_source") >= float(cut)).cast("int"))


def importances(rows: DataFrame, model: RandomForestClassificationModel, features: list[str]) -> DataFrame:
    """``(feature, importance)``, largest first."""
    table = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return rows.sparkSession.createDataFrame(table, "feature string, importance double")


def partial_dependence(rows: DataFrame, feature: str, score, points: int = 30) -> DataFrame:
    """``(value, mean_prob)``: the mean score of all rows when ``feature`` is set to each of ``points`` values between its 5th and 95th percentile."""
    ends = {r.share: r.cut for r in quantiles(rows, feature, [0.05, 0.95]).collect()}  # two rows
    if not ends:
        raise ValueError(f"{feature} has no values")
    low, high = ends[0.05], ends[0.95]
    values = [low + (high - low) * k / (points - 1) for k in range(points)]
    spread = rows.withColumn(feature, F.explode(F.array(*map(F.lit, values))))
    return score(spread).groupBy(F.col(feature).alias("value")).agg(F.avg("prob_source").alias("mean_prob"))


def held_out(rows: DataFrame, label: str) -> DataFrame:
    """The table of predictions for rows that weren't trained on."""
    return rows.where(~F.col("is_train")).select(F.col(label).alias("y_true"), "prob_source", "pred_source")
