"""Outlines, layers, settings, feature tables and searches."""

import random

import pytest
from pyspark.sql import functions as F

from cellframe.functions import expr as E
from cellframe.operators import curves, features, grid, scenes
from cellframe.plans import config, jobs
from cellframe.sources import tables


def cells_of(spark, rows):
    return spark.createDataFrame([(r * len(rows[0]) + c, r, c) for r, row in enumerate(rows) for c, v in enumerate(row) if v], "cid long, r long, c long")


def test_outline_of_a_ring_with_a_hole(spark):
    parts = grid.components(cells_of(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]]))
    shape = grid.outlines(grid.outline_points(parts)).select(grid.well_known_text("rings").alias("t"), E.polygon_area("rings").alias("a")).first()
    assert shape.t == "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0), (2 1, 1 1, 1 2, 2 2, 2 1))" or shape.t.startswith("POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0), (")
    assert shape.a == 8.0


def test_outlines_lie_around_their_cells(spark):
    rng = random.Random(9)
    mask = [[int(rng.random() < 0.6) for _ in range(15)] for _ in range(15)]
    parts = grid.components(cells_of(spark, mask))
    shapes = grid.outlines(grid.outline_points(parts))
    every = spark.createDataFrame([(r * 15 + c, r, c) for r in range(15) for c in range(15)], "cid long, r long, c long")
    inside = scenes.in_polygons(15, shapes.withColumnRenamed("component", "poly_id"), every)
    assert {(r.poly_id, r.cid) for r in inside.collect()} == {(r.component, r.cid) for r in parts.collect()}


def test_geojson(spark, tmp_path):
    layer = spark.createDataFrame([(1, "a", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]])], f"id int, name string, rings {tables.RINGS}")
    tables.write_geojson(layer, f"{tmp_path}/x")
    assert tables.read_geojson(spark, f"{tmp_path}/x", "id int, name string", lines=True).collect() == layer.collect()
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":1},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}},{"type":"Feature","properties":{"id":2},"geometry":null}]}'
    (tmp_path / "c.json").write_text(text)
    got = {r.id: r.rings for r in tables.read_geojson(spark, f"{tmp_path}/c.json", "id int").collect()}
    assert len(got[1]) == 2 and got[1][1][0].x == 5.0 and got[2] == []
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    tables.write_sorted(rows, f"{tmp_path}/s", ["k"])
    assert spark.read.csv(f"{tmp_path}/s", header=True).count() == 2


def test_barriers(spark):
    area = spark.createDataFrame([(r * 6 + c, r, c) for r in range(6) for c in range(6)], "cid long, r long, c long")
    line = spark.createDataFrame([([{"x": 2.5, "y": -1.0}, {"x": 2.5, "y": 7.0}],)], "points array<struct<x:double,y:double>>")
    crossed = grid.crossed_cells(line, 6, 6)
    assert {(r.r, r.c) for r in crossed.collect()} == {(r, 2) for r in range(6)}
    parts = grid.parted(area, crossed).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in parts} == {0: 12, 3: 18}
    slope = spark.createDataFrame([([{"x": 0.2, "y": 0.5}, {"x": 3.6, "y": 0.5}, {"x": 3.6, "y": 2.5}],)], "points array<struct<x:double,y:double>>")
    assert {(r.r, r.c) for r in grid.crossed_cells(slope, 6, 6).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}


def test_contacts_cut_between_cells(spark):
    """Every cell is in a part, and parts are those of a plain flood that doesn't cross the lines."""
    import random

    rng = random.Random(8)
    n = 14
    inside = [(r, c) for r in range(n) for c in range(n) if rng.random() < 0.85]
    lines = [[(0.0, 4.5), (14.0, 4.5)], [(7.5, 0.0), (7.5, 14.0)], [(1.2, 1.1), (12.7, 9.4), (3.3, 13.2)], [(5.0, 5.0), (9.0, 9.0)], [(2.5, 6.5), (6.5, 10.5)], [(3.0, 3.0)], [(13.0, 11.5), (0.5, 11.5)], [(9.5, 13.0), (9.5, 1.0)]]
    area = spark.createDataFrame([(r * n + c, r, c) for r, c in inside], "cid long, r long, c long")
    table = spark.createDataFrame([([{"x": x, "y": y} for x, y in line],) for line in lines], "points array<struct<x:double,y:double>>")
    got = {r.cid: r.component for r in grid.divided(area, table, n, n).collect()}

    def crossed(a, b):
        # centres are moved by a little, as the rule says, so that no line touches one
        (ax, ay), (bx, by) = ((c + 0.5 - 1e-5, r + 0.5 - 1e-9) for r, c in (a, b))
        side = lambda px, py, qx, qy, x, y: (qx - px) * (y - py) - (qy - py) * (x - px)
        for line in lines:
            for (px, py), (qx, qy) in zip(line, line[1:]):
                if side(px, py, qx, qy, ax, ay) * side(px, py, qx, qy, bx, by) < 0 and side(ax, ay, bx, by, px, py) * side(ax, ay, bx, by, qx, qy) < 0:
                    return True
        return False

    label, there = {}, set(inside)
    for start in inside:
        if start not in label:
            label[start], todo = start, [start]
            while todo:
                r, c = todo.pop()
                for q in ((r, c + 1), (r + 1, c), (r, c - 1), (r - 1, c)):
                    if q in there and q not in label and not crossed((r, c), q):
                        label[q] = start
                        todo.append(q)
    assert got == {r * n + c: label[r, c][0] * n + label[r, c][1] for r, c in inside} and len(set(got.values())) > 8


def test_settings():
    own = {"source_area": {"top_percent_values": [25], "dem_diff": "b.tif"}, "paths": {"dem_diff": "/a.tif", "output_dir": "out"}, "outputs": {"pci": "mine/p", "pci_threshold": 0.6}, "parameters": {"alpha": 2, "k": 0.05}, "inputs": {"na": {"mode": "constant", "value": 0.03}}, "other": 1}
    got = config.job_settings(own, "/root")
    assert got.source_area.top_percent_values == (25,) and got.source_area.c_channel_max == 120 and got.alpha == 2.0 and got.soil.k == 0.05 and got.soil.rho_s == 2650.0
    assert config.job_settings().source_area.top_percent_values == (10, 5) and config.job_settings().draws.n_samples == 1500
    assert got.inputs["na"] == {"mode": "constant", "value": 0.03} and got.inputs["d50"]["mean"] == 2.0
    assert got.change_band() == "/a.tif" and config.job_settings({"source_area": {"dem_diff": "b.tif"}}, "/r").change_band() == "/r/b.tif"
    assert got.output("slope") == "/root/data/processed/slope" and got.output("pci") == "/root/mine/p" and got.output("source_polygons") == "/root/out/source_polygons"
    assert config.first_existing(["x", "y"], lambda p: p == "y") == "y" and config.first_existing(["x", "y"], lambda p: False) == "x"
    assert got.place("hdfs://n/x") == "hdfs://n/x"
    assert got.least_area() == 0.0 and config.job_settings({"outputs": {"min_area_m2": 5}}).least_area() == 5.0
    assert config.job_settings({"terrain": {"flow_director": "Steepest"}}).terrain.neighbours() == 4
    for wrong in (lambda: config.job_settings().change_band(), lambda: config.job_settings({"terrain": {"flow_director": "MFD"}}).terrain.neighbours()):
        with pytest.raises(ValueError):
            wrong()


def test_source_area_workflow(spark):
    cells = spark.createDataFrame([(k, k // 4, k % 4, 1.0 + k * 69 / 15, -0.5, k / 16) for k in range(16)], "cid long, r long, c long, g double, dz double, pci double")
    got = jobs.source_area_workflow(cells, config.job_settings({"source_area": {"top_percent_values": [25], "c_min_values": [10, 20, 60], "c_channel_max": 50}}), 100.0)
    top = got["cell_rows"].first()
    assert (top.top_percent, top.source_pixels, top.source_area_m2) == (25.0, 4, 400.0) and top.pci_cutoff == pytest.approx(0.703125)
    bands = {r.c_min: r for r in got["c_band_polygon_rows"].collect()}
    assert bands[10.0].n_polygons == 1 and bands[60.0].n_polygons == 0 and bands[60.0].polygon_area_m2 == 0.0 and bands[10.0].dod_filter
    assert {r.method for r in got["polygons"].collect()} == {"pci_top_percent_dod", "c_band_dod"}


def test_features_and_search(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((k, a, b, [a, b, None], int(a + 0.3 * b + rng.gauss(0, 0.3) > 0)))
    df = spark.createDataFrame(rows, "cid long, a double, b double, e array<double>, y int")
    wide = features.band_columns(df.select("cid", "e"), "e")
    assert wide.columns == ["cid", "band_01", "band_02"]
    table = features.assembled(df, {"band_01": wide}, ["a", "band_01", "c"], F.col("y"), "skip")
    assert table.columns == ["cid", "y", "a", "band_01"] and table.count() == 300
    with pytest.raises(ValueError):
        features.assembled(df, {}, ["c"], F.col("y"))
    assert len({str(x) for x in features.sampled_grid(features.FOREST_CHOICES, 50, 1)}) == 50 and len(features.sampled_grid({"a": [1, 2]}, 9, 1)) == 2
    found, best = features.searched_forest(df, "y", ["a", "b"], "cid", 2, 2, choices={"numTrees": [3, 6], "maxDepth": [2, 4]})
    lines = best.collect()
    assert [r.rank_test_score for r in lines] == [1, 2] and lines[0].mean_test_score >= lines[1].mean_test_score > 0.7
    split = df.withColumn("is_train", F.col("cid") % 4 > 0).withColumn("t", F.col("a") * 2 - F.col("b")).withColumn("e", F.slice("e", 1, 2))
    _, said = features.embedding_regression(split, "e", "t")
    assert curves.regression_scores(said, "t", "said").first().r2 > 0.99
    edges = spark.createDataFrame([(k, k + 1) for k in range(299)], "src long, dst long")
    _, scored = features.graph_classifier(df.select(F.col("cid").alias("id"), "a", "b", "y"), edges, "y", ["a", "b"])
    assert scored.where("y = pred_source").count() > 260 and "a_2" in scored.columns


def test_small_columns(spark):
    one = spark.range(1).select(E.leaf_area(F.lit(35.0)).alias("lai"), E.without_channels(F.lit(0.5), F.lit(130.0)).alias("gone"), E.without_channels(F.lit(0.5), F.lit(None).cast("double")).alias("kept")).first()
    assert (one.lai, one.gone, one.kept) == (3.5, None, 0.5)
    rows = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 5.0)], "component long, area_m2 double")
    assert [r.component for r in scenes.largest(rows, 2).collect()] == [2, 3]


def test_bands_templates_and_graphs(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf")])], "cid long, e array<double>")
    assert [r.cid for r in tables.all_bands_valid(rows, "e").collect()] == [1]
    left = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0)], "grid_id long, r long, c long, a double")
    right = left.withColumnRenamed("a", "b")
    same = spark.createDataFrame([(0, "a", 2, 10.0), (0, "b", 2, 10.0)], "grid_id long, band string, width int, dx double")
    assert scenes.aligned(left, right, same).count() == 2
    with pytest.raises(ValueError):
        scenes.aligned(left, right, same.withColumn("dx", F.when(F.col("band") == "a", 1.0).otherwise(2.0)))
    template = spark.createDataFrame([(1, 5.0), (2, None)], "cid long, v double")
    assert [r.cid for r in scenes.same_template(rows, template, "v").collect()] == [1]
    assert grid.undirected(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")).count() == 4
    with pytest.raises(ValueError):
        scenes.composite(spark.createDataFrame([], "cid long, ts timestamp_ntz, value double"), "2024-01-01", "2024-02-01", "mean", on_empty="error")


def test_holes_are_filled(spark):
    mask = [[0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 1, 0], [0, 0, 1, 1, 0]]
    got = {(r.r, r.c) for r in grid.without_holes(cells_of(spark, mask), 5, 5).collect()}
    assert got == {(r, c) for r in range(5) for c in range(5) if mask[r][c]} | {(1, 2)}


def test_scaling_and_projection(spark):
    rows = spark.createDataFrame([(1.0, 7.0), (None, 7.0), (3.0, 7.0), (8.0, None)], "a double, b double")
    got = [(r.a, r.b) for r in curves.imputed_and_scaled(rows, ["a", "b"]).orderBy("a").collect()]
    std = ((3**2 + 1 + 4**2) / 3) ** 0.5
    assert got[0][0] == pytest.approx(-2 / std) and got[1][0] == 0.0 and {b for _, b in got} == {0.0}
    one = spark.range(1).select(*[c.alias(n) for n, c in zip("zen", E.utm_forward(F.lit(3.0), F.lit(45.0)))]).first()
    assert (one.z, one.e) == (31, pytest.approx(500000.0)) and one.n == pytest.approx(4982950.4, abs=0.1)
    east = spark.range(1).select(*[c.alias(n) for n, c in zip("zen", E.utm_forward(F.lit(-119.6), F.lit(34.4)))]).first()
    assert east.z == 11 and 250000 < east.e < 270000 and 3800000 < east.n < 3820000


def test_areas_of_a_layer_in_degrees(spark):
    """One zone for the layer, closed and open rings alike, holes taken off, odd polygons."""
    from cellframe.operators import layers

    square = [(3.0, 45.0), (3.01, 45.0), (3.01, 45.01), (3.0, 45.01)]
    hole = [(3.002, 45.002), (3.004, 45.002), (3.004, 45.004)]
    corner = lambda ring: [{"x": x, "y": y} for x, y in ring]
    rows = [(1, [corner(square)]), (2, [corner([*square, square[0]])]), (3, [corner(square[::-1]), corner(hole)]), (4, []), (5, None), (6, [[]]), (7, [corner([(9.0, 45.0)])])]
    schema = "id long, rings array<array<struct<x:double,y:double>>>"
    got = {r.id: (r.zone, r.area_m2) for r in layers.geographic_areas(spark.createDataFrame(rows, schema)).collect()}
    assert {z for z, _ in got.values()} == {32}  # the middle of 3 and 9 degrees east
    alone = {r.id: (r.zone, r.area_m2) for r in layers.geographic_areas(spark.createDataFrame(rows[:6], schema)).collect()}
    north, east = 111_132.95 - 559.85 * 0.0001745 + 1.2, 111_412.84 * 0.70704 - 93.5 * -0.70711
    assert alone[1][0] == 31 and alone[1][1] == pytest.approx(north * east / 1e4 * 0.9996**2, rel=3e-3)
    assert alone[2][1] == pytest.approx(alone[1][1], rel=1e-12) and 0.97 < alone[3][1] / alone[1][1] < 0.99
    assert [alone[k][1] for k in (4, 5, 6)] == [0.0, 0.0, 0.0]
    assert layers.geographic_areas(spark.createDataFrame([], schema)).collect() == []
