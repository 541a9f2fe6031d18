"""Tiles of cells against plain walks over whole grids."""

import random

import numpy as np
import pytest

from cellframe.operators import grid, tiles


def table(spark, z, name="z"):
    flat = [(r * len(z[0]) + c + 7, r, c, None if v is None else float(v)) for r, row in enumerate(z) for c, v in enumerate(row) if v != "no"]
    return spark.createDataFrame(flat, f"cid long, r long, c long, {name} double")


def plain(z, offsets=grid.EIGHT):
    """Each cell's neighbours, way and, over flats, the way that is nearest to a way down."""
    at = {(r, c): v for r, row in enumerate(z) for c, v in enumerate(row) if v is not None and v != "no"}
    near = {p: [(k, (p[0] + dr, p[1] + dc), (dr * dr + dc * dc) ** 0.5) for k, (dr, dc) in enumerate(offsets) if (p[0] + dr, p[1] + dc) in at] for p in at}
    steep = {}
    for p in at:
        drops = [((at[p] - at[q]) / d, -k) for k, q, d in near[p]]
        if drops and max(drops)[0] > 0:
            steep[p] = -max(drops)[1]
    round_ = {p: sum((p[0] + dr, p[1] + dc) in at for dr, dc in grid.EIGHT) for p in at}
    level = {p: 0 for p in at if p in steep or round_[p] < 8}
    front, way = list(level), dict(steep)
    while front:
        new = {}
        for p in at:
            if p not in level:
                ks = [k for k, q, _ in near[p] if at[q] == at[p] and q in level and level[q] == level[front[0]]]
                if ks:
                    new[p] = min(ks)
        for p, k in new.items():
            way[p], level[p] = k, level[front[0]] + 1
        front = list(new)
    return at, steep, way


def counts(at, way, offsets=grid.EIGHT):
    up = dict.fromkeys(at, 0)
    for p in at:
        while True:
            up[p] += 1
            if p not in way:
                break
            p = (p[0] + offsets[way[p]][0], p[1] + offsets[way[p]][1])
    return up


def rough(seed, height=17, width=23, levels=40):
    rng = random.Random(seed)
    z = [[rng.choice([None, "no", *[rng.randint(0, levels)] * 30]) for _ in range(width)] for _ in range(height)]
    return z


@pytest.mark.parametrize("size", [3, 5, 256])
@pytest.mark.parametrize("offsets", [grid.EIGHT, grid.FOUR])
def test_receivers_and_accumulation(spark, size, offsets):
    z = rough(1)
    cells = table(spark, z)
    at, steep, _ = plain(z, offsets)
    name = lambda p: p[0] * len(z[0]) + p[1] + 7
    got = {r.cid: (r.receiver, r.k) for r in tiles.receivers(cells, "z", 10.0, offsets, size).collect()}
    assert got == {name(p): (name((p[0] + offsets[k][0], p[1] + offsets[k][1])), k) for p, k in steep.items()}
    got = {r.cid: r.cells_up for r in tiles.accumulated(grid.kept(tiles.flow_of_descent(cells, "z", offsets, size)), size).collect()}
    up = counts(at, steep, offsets)
    assert {k: v for k, v in got.items() if k in {name(p) for p in at}} == {name(p): n for p, n in up.items()}


def test_long_way_through_many_tiles(spark):
    """One way that winds through all cells, in and out of tiles of 4 x 4."""
    n = 24
    order = [(r, c if r % 2 == 0 else n - 1 - c) for r in range(n) for c in range(n)]
    z = np.zeros((n, n))
    for k, p in enumerate(order):
        z[p] = -k
    wall = [[float(v) for v in row] for row in z]
    cells = table(spark, wall)
    flow = grid.kept(tiles.flow_of_descent(cells, "z", [(0, -1), (0, 1), (1, 0)], 4))
    got = {r.cid - 7: r.cells_up for r in tiles.accumulated(flow, 4).collect()}
    steps = counts(*(lambda at, steep, way: (at, steep))(*plain(wall, [(0, -1), (0, 1), (1, 0)])), [(0, -1), (0, 1), (1, 0)])
    assert got == {r * n + c: v for (r, c), v in steps.items()} and max(got.values()) > 20


@pytest.mark.parametrize("size", [4, 6, 256])
def test_flats(spark, size):
    z = rough(4, 20, 26, 2)
    z = [[v if not 3 < r < 16 or not 3 < c < 22 or v in (None, "no") else 5 for c, v in enumerate(row)] for r, row in enumerate(z)]
    cells = table(spark, z, "filled")
    at, _, way = plain(z)
    got = {r.cid: r.k for r in tiles.flow_rows(tiles.drained(cells, size=size), size).collect()}
    name = lambda p: p[0] * len(z[0]) + p[1] + 7
    assert {p: got[name(p)] for p in at} == {p: way.get(p) for p in at}


def test_wide_flat_takes_few_rounds(spark):
    """A flat corridor of 2,000 cells, out at one end: rounds follow the tiles that it crosses."""
    width = 2000
    z = [[9.0] * width] + [[9.0] + [5.0] * (width - 2) + [9.0] for _ in range(3)] + [[9.0] * width]
    z[2][width - 1] = 1.0
    cells = table(spark, z, "filled")
    flow = tiles.drained(cells, most_rounds=30)
    got = {r.cid - 7: r.cells_up for r in tiles.accumulated(flow).collect()}
    assert got[2 * width + width - 1] >= 3 * (width - 2) and len(got) == 5 * width


def test_neighbour_means(spark):
    z = rough(6)
    z = [[None if v == "no" else v for v in row] for row in z]
    at = {(r, c): float(v) for r, row in enumerate(z) for c, v in enumerate(row) if v is not None}
    mean = lambda vals, p: (lambda xs: sum(xs) / len(xs) if xs else 0.0)([vals[q] for q in ((p[0] + dr, p[1] + dc) for dr, dc in grid.FOUR) if q in vals])
    one = {p: mean(at, p) for p in at}
    two = {p: mean(one, p) for p in at}
    for size in (4, 256):
        got = {r.id: (r.z_1, r.z_2) for r in tiles.neighbour_means(table(spark, z).where("z IS NOT NULL"), "z", 2, size=size).collect()}
        assert got == {p[0] * 23 + p[1] + 7: (pytest.approx(one[p]), pytest.approx(two[p])) for p in at}


def test_empty_grid(spark):
    cells = spark.createDataFrame([], "cid long, r long, c long, z double")
    assert tiles.receivers(cells).collect() == []
    assert tiles.accumulated(grid.kept(tiles.flow_of_descent(cells))).collect() == []
    assert tiles.flow_rows(tiles.drained(cells, "z")).collect() == []


def test_runs_of_rings_are_the_rings(spark):
    """Runs of five corners give the same texts, areas and lengths as whole rings."""
    rng = random.Random(11)
    n = 24
    cells = spark.createDataFrame([(r * n + c, r, c) for r in range(n) for c in range(n) if rng.random() < 0.62], "cid long, r long, c long")
    points = grid.kept(grid.outline_points(grid.kept(grid.components(cells))))
    whole = {r.component: r.text for r in grid.outlines(points).select("component", grid.well_known_text().alias("text")).collect()}
    for run in (5, 512):
        runs = grid.kept(grid.ring_runs(points, run))
        assert {r.component: r.geometry for r in grid.run_texts(runs).collect()} == whole
        assert all(len(r.points) <= run for r in runs.collect())
        measures = grid.run_measures(runs).collect()
        assert sum(r.area for r in measures) == cells.count() and any(r.hole and r.area < 0 for r in measures)
    assert grid.ring_runs(points.limit(0)).collect() == []
