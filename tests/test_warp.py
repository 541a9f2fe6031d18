"""Bands warped between grids and reference systems."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellframe.functions import expr as E
from cellframe.operators import scenes
from cellframe.operators.warp import Grid, between, warped

DEGREES = Grid(40, 50, -119.75, 34.45, 0.0003, -0.00027, 0.00002, 0.00001)
METRES = Grid(30, 33, 247420.0, 3815900.0, 31.0, -29.0, 3.0, -2.0, zone=11)


def band(spark, height, width, missing=0.1, seed=4):
    rng = random.Random(seed)
    rows = [(r, c, None if rng.random() < missing else rng.uniform(0, 9)) for r in range(height) for c in range(width)]
    return {(r, c): v for r, c, v in rows}, spark.createDataFrame(rows, "r long, c long, v double")


def test_inverse_undoes_the_projection(spark):
    rng = random.Random(1)
    rows = [(lat, lon, zone) for _ in range(400) for zone in [rng.randint(1, 60)] for lat in [rng.uniform(-80, 84)] for lon in [zone * 6 - 183 + rng.uniform(-3, 3)]]
    rows += [(0.0, -117.0, 11), (45.0, -117.0, 11), (0.0, 177.0, 60)]
    points = spark.createDataFrame(rows, "lat double, lon double, zone int")
    _, x, y = E.utm_forward("lon", "lat", F.col("zone"))
    back = points.withColumn("x", x).withColumn("y", y).withColumn("p", E.utm_inverse("x", "y", F.col("zone")))
    for row in back.collect():
        assert abs(row.lat - row.p.lat) < 1e-7 and abs(row.lon - row.p.lon) * math.cos(math.radians(row.lat)) < 1e-7


def test_cells_and_places_of_turned_axes(spark):
    y, x = METRES.cell(*METRES.place(F.lit(7.25), F.lit(3.5)))
    row = spark.range(1).select(y.alias("y"), x.alias("x")).first()
    assert abs(row.y - 7.25) < 1e-6 and abs(row.x - 3.5) < 1e-6


@pytest.mark.parametrize("source,target", [(DEGREES, METRES), (METRES, DEGREES), (METRES, Grid(9, 9, 247420.0, 3815900.0, 90.0, -90.0, zone=11))])
@pytest.mark.parametrize("method", ["nearest", "bilinear", "average"])
def test_against_plain_loops(spark, source, target, method):
    values, cells = band(spark, source.height, source.width)
    got = {(r.r, r.c): r.value for r in warped(cells, "v", source, target, method).collect()}
    assert set(got) == {(r, c) for r in range(target.height) for c in range(target.width)}
    grid = spark.range(target.height * target.width).select(F.floor(F.col("id") / target.width).alias("r"), (F.col("id") % target.width).alias("c"))
    places = [(0.5, 0.5), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    found = grid.select("r", "c", *[between(source, target, F.col("r") + i, F.col("c") + j).alias(f"p{n}") for n, (i, j) in enumerate(places)]).collect()
    known = 0
    for row in found:
        (y, x), corners = row.p0, [row[f"p{n}"] for n in range(1, 5)]
        want = None
        on = 0 <= y < source.height and 0 <= x < source.width
        if method == "nearest" and on:
            want = values.get((math.floor(y), math.floor(x)))
        elif method != "nearest":
            weights = {}
            if method == "bilinear" and on:
                for i in (math.floor(y - 0.5), math.floor(y - 0.5) + 1):
                    for j in (math.floor(x - 0.5), math.floor(x - 0.5) + 1):
                        weights[i, j] = (1 - abs(y - 0.5 - i)) * (1 - abs(x - 0.5 - j))
            elif method == "average":
                ends = [f(p[k] for p in corners) for k in (0, 1) for f in (min, max)]
                for i in range(max(0, math.floor(ends[0])), min(source.height, math.ceil(ends[1]))):
                    for j in range(max(0, math.floor(ends[2])), min(source.width, math.ceil(ends[3]))):
                        weights[i, j] = (min(i + 1, ends[1]) - max(i, ends[0])) * (min(j + 1, ends[3]) - max(j, ends[2]))
            valid = {k: w for k, w in weights.items() if values.get(k) is not None and w > 0}
            want = sum(w * values[k] for k, w in valid.items()) / sum(valid.values()) if valid else None
        assert (got[row.r, row.c] is None) == (want is None) and (want is None or abs(got[row.r, row.c] - want) < 1e-9)
        known += want is not None
    assert known > 50


def test_one_system_and_origin_is_plain_resampling(spark):
    _, cells = band(spark, 12, 15, missing=0)
    source, target = Grid(12, 15, 100.0, 900.0, 10.0, -10.0, zone=11), Grid(4, 5, 100.0, 900.0, 30.0, -30.0, zone=11)
    for method in ("nearest", "average"):
        plain = {(r.r, r.c): r.value for r in scenes.resampled(cells, "v", 3.0, 4, 5, method).collect()}
        for row in warped(cells, "v", source, target, method).collect():
            assert abs(row.value - plain[row.r, row.c]) < 1e-9


def test_template_and_odd_values(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, None), (1, 1, 4.0), (7, 7, 9.0)], "r long, c long, v double")
    here = Grid(2, 2, 0.0, 0.0, 1.0, 1.0)
    template = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (5, 5)], "r long, c long")
    for method in ("nearest", "bilinear", "average"):
        assert {(r.r, r.c, r.value) for r in warped(cells, "v", here, here, method, template).collect()} == {(0, 0, 1.0), (0, 1, None)}
        assert {r.value for r in warped(cells.limit(0), "v", here, here, method).collect()} == {None}
        away = Grid(2, 2, 50.0, 50.0, 1.0, 1.0)
        assert [r.value for r in warped(cells, "v", here, away, method).collect()] == [None] * 4


def test_headers_are_checked(spark):
    for bad in ({"height": 0}, {"zone": 61}, {"dx": 0.0}):
        with pytest.raises(ValueError):
            Grid(**({"height": 2, "width": 2, "x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0} | bad))
    with pytest.raises(ValueError):
        warped(spark.createDataFrame([(0, 0, 1.0)], "r long, c long, v double"), "v", METRES, METRES, "cubic")
