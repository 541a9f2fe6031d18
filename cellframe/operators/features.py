"""Targets and feature tables of cells, and models that are made of them."""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col, core_valid, finite, non_channel
from ..functions.sampling import uniform
from . import models
from .grid import neighbour_means, undirected
from .shared import kept


def target_physics(threshold: float = -0.277, c_min: float = 20.0, cutoff: float = 120.0, dz: str = "dz", g: str = "g", **inputs) -> Column:
    """1 where a cell that is no channel was eroded and its index is in the source band, 0 for other such cells, NULL for the rest."""
    eroded = (col(dz) < float(threshold)) & (col(g) >= float(c_min)) & (col(g) < float(cutoff))
    return F.when(non_channel(g, cutoff, dz=dz, **inputs), eroded.cast("int"))


def target_change(threshold: float = -0.277, cutoff: float = 120.0, dz: str = "dz", g: str = "g", **inputs) -> Column:
    """1 where a cell that is no channel was eroded, 0 for other such cells, NULL for the rest."""
    return F.when(non_channel(g, cutoff, dz=dz, **inputs), (col(dz) < float(threshold)).cast("int"))


def target_in_band(threshold: float = -0.277, c_source: float = 20.0, cutoff: float = 120.0, dz: str = "dz", g: str = "g", **inputs) -> Column:
    """1 where a cell was eroded and its index is in the source band; channels are 0 like other valid cells, and the index needn't be over 0."""
    source = (col(g) >= float(c_source)) & (col(g) < float(cutoff)) & (col(dz) < float(threshold))
    return F.when(core_valid(g=g, dz=dz, need_g=False, **inputs), source.cast("int"))


def assembled(cells: DataFrame, layers: dict[str, DataFrame], selected: list[str], target: Column, on_missing: str = "error", key: str = "cid") -> DataFrame:
    """``(key, y, features)``: cells with a target and all selected features.

    A feature is a column of ``cells`` or of the layer of its name, joined by the
    key. One that is in neither is an error, or is left out with ``on_missing="skip"``.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError(f"on_missing is error or skip, not {on_missing}")
    lost = [f for f in selected if f not in cells.columns and f not in layers]
    if lost and on_missing == "error":
        raise ValueError(f"no such features: {', '.join(lost)}")
    names = [f for f in selected if f not in lost]
    out = cells.withColumn("y", target).where("y IS NOT NULL").select(key, "y", *[f for f in names if f in cells.columns])
    for f in names:
        if f not in cells.columns:
            out = out.join(layers[f].select(key, F.col(f)), key)
    valid = out.select(key, "y", *[finite(f).alias(f) for f in names])
    return valid.dropna(subset=names) if names else valid


def band_columns(cells: DataFrame, bands: str, prefix: str = "band_", most: int = 16) -> DataFrame:
    """The first ``most`` bands of an array as columns ``prefix01..``; bands without any value are left out."""
    n = min(most, cells.agg(F.max(F.size(bands))).first()[0] or 0)
    named = {f"{prefix}{k + 1:02d}": finite(F.get(F.col(bands), k)) for k in range(n)}
    out = cells.withColumns(named).drop(bands) if named else cells.drop(bands)
    counts = out.agg(*[F.count(f).alias(f) for f in named]).first() if named else {}
    return out.drop(*[f for f in named if not counts[f]])


def sampled_grid(choices: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` different combinations of the choices, or all if they are fewer."""
    total = 1
    for values in choices.values():
        total *= len(values)
    picked = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for k in picked:
        one = {}
        for name, values in choices.items():
            k, at = divmod(k, len(values))
            one[name] = values[at]
        out.append(one)
    return out


#: Choices of a forest's search; MLlib has no smallest size of a split and no weights for each tree's sample.
FOREST_CHOICES = {"numTrees": [5, 10, 20, 30, 40, 50, 60, 70, 80, 100, 120, 150, 200, 300], "maxDepth": [30, 5, 10, 20], "minInstancesPerNode": [1, 2, 4, 8], "featureSubsetStrategy": ["sqrt", "log2", "all"]}


def searched_forest(rows: DataFrame, label: str, features: list[str], key: str, n: int, folds: int = 3, seed: int = 42, choices: dict | None = None, parallelism: int = 2) -> tuple[CrossValidatorModel, DataFrame]:
    """The best forest of ``n`` random settings by F1 of class 1 over stratified folds, and the table of all settings, best first."""
    train, _ = models.balanced(rows, label, features)
    place = F.row_number().over(Window.partitionBy("_y", "_b").orderBy("_u", key))  # in 64 lots of a class, so no lot is large
    train = train.withColumn("_y", F.col(label).cast("double")).withColumn("_u", uniform(seed, "fold", key)).withColumn("_b", F.floor(F.col("_u") * 64))
    train = train.withColumn("_fold", (place % folds).cast("int"))
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(train).select("_x", "_y", "weight", "_fold")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="weight", seed=seed)
    grid = [{forest.getParam(k): v for k, v in one.items()} for one in sampled_grid(choices or FOREST_CHOICES, n, seed)]
    score = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0)
    found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=score, foldCol="_fold", numFolds=folds, parallelism=parallelism, seed=seed).fit(vectors)
    table = sorted(zip(found.avgMetrics, found.stdMetrics, grid, strict=True), key=lambda x: -x[0])
    lines = [(k + 1, float(m), float(s), ", ".join(f"{p.name}={v}" for p, v in one.items())) for k, (m, s, one) in enumerate(table)]
    return found, rows.sparkSession.createDataFrame(lines, "rank_test_score int, mean_test_score double, std_test_score double, params string")


def embedding_regression(rows: DataFrame, bands: str, label: str, trees: bool = False, seed: int = 42):
    """A regression of a label on an array of bands, linear or by boosted trees, fitted on rows with ``is_train``, and all rows with ``said``."""
    whole = rows.where(F.col(label).isNotNull() & F.forall(bands, lambda x: finite(x).isNotNull()))
    vectors = whole.withColumn("_x", array_to_vector(F.transform(bands, lambda x: x.cast("double"))))
    kind = GBTRegressor(seed=seed) if trees else LinearRegression(regParam=1e-6)
    model = kind.setFeaturesCol("_x").setLabelCol(label).setPredictionCol("said").fit(vectors.where("is_train"))
    return model, model.transform(vectors).drop("_x")


def graph_classifier(nodes: DataFrame, edges: DataFrame, label: str, features: list[str], hops: int = 2) -> tuple[models.Logistic, DataFrame]:
    """A logistic model of a node's features and of their means over ``hops`` rings of neighbours, and the nodes scored by it.

    Edges and the nodes with their means are written before they are read again: each pass of the fit would plan and do all joins anew.
    """
    wide = kept(neighbour_means(nodes, kept(undirected(edges)), features, hops))
    names = [*features, *[f"{f}_{k}" for k in range(1, hops + 1) for f in features]]
    train = wide.where("is_train") if "is_train" in wide.columns else wide
    model = models.logistic(train, label, names)
    return model, models.scored(wide, model)
