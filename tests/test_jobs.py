"""Datasets, models and end-to-end jobs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions import sampling as S
from cellframe.operators import models
from cellframe.plans import config, jobs
from cellframe.sources import tables


def test_band_round_trip(spark, tmp_path):
    rows = [(r, c, None if (r, c) == (1, 1) else math.inf if (r, c) == (2, 70) else r * 100.5 + c) for r in range(3) for c in range(80)]
    tables.write_band(spark.createDataFrame(rows, "r long, c long, v double"), f"{tmp_path}/band", "v")
    got = {(x.r, x.c): x.v for x in tables.read_band(spark, f"{tmp_path}/band", "v").collect()}
    assert got == {(r, c): None if v is None or math.isinf(v) else v for r, c, v in rows}


def test_mask_layer_rows_and_samples(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 0, None)], "r long, c long, m boolean")
    tables.write_mask(cells, f"{tmp_path}/m", "m", 255)
    assert {(x.r, x.c): x.m for x in spark.read.parquet(f"{tmp_path}/m").collect()} == {(0, 0): 255, (0, 1): 0, (1, 0): None}
    for name, layer in (("a", spark.range(2)), ("b", spark.range(3).withColumn("more", F.lit(1)))):
        tables.write_layer(layer, f"{tmp_path}/{name}")
        tables.write_layer(layer, f"{tmp_path}/{name}")
    both = tables.read_layers(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert both.count() == 5 and both.where("more IS NULL").count() == 2 and both.where("source_file IS NULL").count() == 0
    tables.write_rows(spark.createDataFrame([("1.5", 1), ("", 2), ("-1", 3), ("inf", 4), ("x", 5)], "C string, i int"), f"{tmp_path}/c")
    assert [r.C for r in tables.read_samples(spark, f"{tmp_path}/c").collect()] == [1.5]


def test_reused_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(4)

    assert [tables.reused(spark, f"{tmp_path}/x", build).count() for _ in range(2)] == [4, 4] and len(built) == 1


def training(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(5, 2, 400), rng.normal(-1, 0.5, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(a - 6 + 2 * (b + 1))))).astype(int)
    return spark.createDataFrame([(float(p), float(q), int(t)) for p, q, t in zip(a, b, y)], "a double, b double, y int"), a, b, y


def test_logistic_against_newton(spark):
    rows, a, b, y = training(spark)
    model = models.logistic(rows, "y", ["a", "b"])
    x = np.column_stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std(), np.ones(400)])
    weight, ridge, w = np.where(y == 1, 200 / y.sum(), 200 / (400 - y.sum())), np.diag([1.0, 1.0, 0.0]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    assert [*model.weights, model.intercept] == pytest.approx(w.tolist(), abs=1e-5)
    got = models.scored(rows, model).select("logit").collect()
    assert [r.logit for r in got] == pytest.approx((x @ w).tolist(), abs=1e-4)
    assert [r.feature for r in models.coefficients(rows, model).collect()] == ["a", "b", "intercept"]
    with pytest.raises(ValueError):
        models.logistic(rows.where("y = 1"), "y", ["a", "b"])


def test_forest(spark):
    rows, *_ = training(spark)
    model = models.forest(rows, "y", ["a", "b"], trees=10, depth=5)
    split = S.stratified_split(models.forest_scored(rows, model, ["a", "b"]).withColumn("id", F.monotonically_increasing_id()), "y", "id", 0.7, 1)
    assert models.held_out(split, "y").columns == ["y_true", "prob_source", "pred_source"]
    assert split.where("y = pred_source").count() > 280
    table = models.importances(rows, model, ["a", "b"]).collect()
    assert sum(r.importance for r in table) == pytest.approx(1) and table[0].feature == "a"
    curve = models.partial_dependence(rows, "a", lambda d: models.forest_scored(d, model, ["a", "b"]), 5).orderBy("value").collect()
    assert len(curve) == 5 and curve[0].mean_prob < curve[-1].mean_prob


def test_source_areas(spark):
    cells = spark.createDataFrame([(k, k // 2, k % 2, 0.1 * k, 10.0 * k, -0.5 if k else 0.0) for k in range(6)], "cid long, r long, c long, pci double, g double, dz double")
    chosen, summary = jobs.source_areas(cells, [50], [10, 500], 40, F.col("dz") < -0.277, 100.0)
    assert {r.label: r.source_pixels for r in summary.collect()} == {"top50": 3, "cmin10_lt_cmax40_g": 3, "cmin500_lt_cmax40_g": 0}
    polygons = {(r.label, r.component): r.n_cells for r in jobs.source_polygons(chosen, 100.0).collect()}
    assert polygons == {("top50", 3): 3, ("cmin10_lt_cmax40_g", 1): 3}


def test_pci_job(spark):
    cells = spark.createDataFrame([(r * 8 + c, r, c, 100.0 - 2 * r - 0.2 * c) for r in range(8) for c in range(8)], "cid long, r long, c long, z double")
    scored, polygons = jobs.pci_job(cells, S.c_samples(spark, 5, 1), 10.0, 0.5)
    rows = {(x.r, x.c): x for x in scored.collect()}
    assert len(rows) == 64 and all(0 <= x.pci <= 1 for x in rows.values())
    assert rows[0, 0].a == 10.0 and rows[6, 0].a == 70.0 and rows[0, 0].s == pytest.approx(0.2)
    high = sum(x.pci >= 0.5 for x in rows.values())
    assert polygons.agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0] == high


def test_bands_meet_as_tiles(spark, tmp_path):
    """Bands written together are as bands written alone; bands of different cells are read as their join by place, which no cell is shuffled for."""
    rows = [(r - 70, c, None if c == 5 else r + 0.5 * c, math.inf if r == 3 else 2.0 * r - c) for r in range(140) for c in range(0, 70, 3)]
    cells = spark.createDataFrame(rows, "r long, c long, v double, w double")
    tables.write_bands(cells, {f"{tmp_path}/v": "v", f"{tmp_path}/w": "w"})
    for name in "vw":
        tables.write_band(cells, f"{tmp_path}/{name}_alone", name)
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect())) == sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}_alone").collect()))
    tables.write_band(cells.where("(r * 7 + c) % 5 <> 0 AND r < 60"), f"{tmp_path}/some", "w")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are large
    try:
        for other in ("w", "some"):
            paths = {"v": f"{tmp_path}/v", "w": f"{tmp_path}/{other}", "x": f"{tmp_path}/v_alone"}
            v, w, x = (tables.read_band(spark, p, n) for n, p in paths.items())
            got, key = tables.read_bands(spark, paths), lambda t: t[:2]
            assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, v.join(w, ["r", "c"]).join(x, ["r", "c"]).collect()), key=key)
            assert "Join [r" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_without_rasters_read_cells_once(spark, tmp_path):
    spark.createDataFrame([(i, 0, i, 2.0 + i if i % 3 else None) for i in range(9)], "cid long, r long, c long, g double").write.parquet(f"{tmp_path}/cells_here")
    got = jobs.scored(spark.read.parquet(f"{tmp_path}/cells_here"), config.job_settings())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [cid") == 1
    assert {r.cid for r in got.collect() if r.pci is None and r.c_model_mean is None} == {0, 3, 6} and got.where("pci IS NOT NULL AND c_model_mean IS NOT NULL").count() == 6
