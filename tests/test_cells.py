"""Hand-computed cases of the cell operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from cellframe.functions import expr as E
from cellframe.functions import sampling as S
from cellframe.operators import curves, grid, scenes, select
from cellframe.plans import queries


def band(spark, rows, name="g"):
    flat = [(r * len(rows[0]) + c, r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(flat, f"cid long, r long, c long, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("cid").collect()]


def test_threshold_by_hand(spark):
    d, na, r = 0.002, 0.03, 45 / 1000 / 3600
    nb = 0.0474 * d ** (1 / 6)
    tau = 0.043 * 9.81 * 1650 * d
    want = (tau / (1000 * 9.81 * nb**1.5 * (nb + na) ** -0.9 * r**0.6)) ** (1 / 0.6)
    assert spark.range(1).select(E.threshold_c(d, na, r).alias("c")).first().c == pytest.approx(want, rel=1e-12)


def test_units(spark):
    got = spark.range(1).select(E.converted(2.0, "d50", {"value_mm": 2.0}).alias("a"), E.converted(2.0, "d50", {"max_mm": 2.0}).alias("b"), E.converted(36.0, "r", {"units": "mm/hr"}).alias("c")).first()
    assert (got.a, got.b) == (0.002, 2.0) and got.c == pytest.approx(1e-5)
    names = ["mm/hr", "mmh", " MM per hour", "millimeter / hour", "furlongs"]
    got = spark.range(1).select(*[E.converted(36.0, "rainfall_excess", {"units": u}).alias(f"x{k}") for k, u in enumerate(names)], E.converted(36.0, "r", {"max_mm_hr": 36.0}).alias("only_max")).first()
    assert [x == pytest.approx(1e-5) for x in got] == [True] * 4 + [False] * 2 and got.only_max == 36.0


def test_non_finite_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-9999.0,), (5.0,)], "v double")
    assert [r.v for r in df.select(E.nodata_to_null("v", -9999.0).alias("v")).collect()] == [None, None, None, 5.0]


def test_deterministic_pci(spark):
    cells = band(spark, [[1, 3], [None, 5]])
    assert column(cells.select("cid", E.deterministic_pci("g", 2.0).alias("p")), "p") == [0.0, 1.0, None, 1.0]


def test_pci_by_rank_ties(spark):
    cells = band(spark, [[1, 2, 3], [None, 5, 10]])
    samples = spark.createDataFrame([(2.0,), (4.0,), (6.0,), (8.0,)], "c double")
    assert column(select.pci_by_rank(cells, samples), "pci") == [0.0, 0.25, 0.25, None, 0.5, 1.0]


def test_top_percent_with_erosion(spark):
    cells = spark.createDataFrame([(0, 0.1, True), (1, 0.2, True), (2, 0.7, True), (3, 0.9, False)], "cid long, pci double, e boolean")
    got = select.top_percent_cells(cells, [50], F.col("e")).collect()
    assert [(r.cid, round(r.pci_cutoff, 9), r.label) for r in got] == [(2, 0.45, "top50")]
    with pytest.raises(ValueError):
        select.top_percent_cut(cells, [0])


def test_c_band(spark):
    rows = [(0, 5.0, True), (1, 10.0, False), (2, 20.0, True), (3, 30.0, True), (4, 120.0, True), (5, None, True)]
    got = select.c_band_cells(spark.createDataFrame(rows, "cid long, g double, e boolean"), [10], 120, F.col("e"))
    assert sorted(r.cid for r in got.collect()) == [2, 3] and got.first().label == "cmin10_lt_cmax120_g"


def test_erosion(spark):
    cells = band(spark, [[-0.3, -0.1], [None, -0.5]], "dz")
    assert column(cells.select("cid", select.eroded("dz", -0.277).alias("e")), "e") == [True, False, False, True]
    assert spark.range(1).select(E.erosion_label(-0.277).alias("x")).first().x == "erosion_mask_dod_lt_minus_0p277m"
    assert spark.range(1).select(E.erosion_label(0.3).alias("x")).first().x == "erosion_mask_dod_lt_plus_0p3m"


def test_labels_in_short_numbers(spark):
    values = [0.0, 5.0, 12.5, -5.0, 0.1, 1e-7, 123456.0, 1234567.0, 0.0001, 0.00001, 1e20, 2 / 3, -1.5e-8, 99999.96, 0.00012345678]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", E.short_number("v").alias("t"), E.band_label("v", F.lit(None).cast("double")).alias("b")).orderBy("k").collect()
    assert [r.t for r in got] == [f"{v:g}" for v in values]
    assert got[3].b == "cminminus5_g" and got[2].b == "cmin12p5_g"


def test_equation_text(spark):
    terms = [("a", 0.5), ("b", -12.34567), ("c", 0.0), ("d", 123456.0)]
    want = "-1.5" + "".join(f" {'+' if w >= 0 else '-'} {abs(w):.4g}*z_{n}" for n, w in terms)
    rows = spark.createDataFrame([(-1.5, [{"name": n, "weight": w} for n, w in terms])], "b double, t array<struct<name:string,weight:double>>")
    assert rows.select(E.equation_text("b", "t", "z_").alias("x")).first().x == want


def test_polygons_of_a_mask(spark):
    mask = band(spark, [[0, 1, 1], [0, 1, 0], [0, 0, 0]]).where("g = 1").select("cid", "r", "c")
    got = grid.polygons(grid.components(mask), 100.0).collect()
    assert [(r.source_id, r.area_m2) for r in got] == [(1, 300.0)]


def test_components_against_flood_fill(spark):
    rng = random.Random(3)
    rows = [[int(rng.random() < 0.55) for _ in range(20)] for _ in range(20)]
    want, seen = {}, set()
    for start in ((r, c) for r in range(20) for c in range(20)):
        if rows[start[0]][start[1]] and start not in seen:
            todo = [start]
            while todo:
                r, c = todo.pop()
                if (r, c) in seen or not (0 <= r < 20 and 0 <= c < 20) or not rows[r][c]:
                    continue
                seen.add((r, c))
                want[r * 20 + c] = start[0] * 20 + start[1]
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    got = grid.components(band(spark, rows).where("g = 1").select("cid", "r", "c"))
    assert {r.cid: r.component for r in got.collect()} == want


def test_sinks_against_priority_flood(spark):
    rng = random.Random(5)
    n = 14
    z = [[rng.random() for _ in range(n)] for _ in range(n)]
    level, heap = {}, [(z[r][c], r, c) for r in range(n) for c in range(n) if r in (0, n - 1) or c in (0, n - 1)]
    level = {(r, c): v for v, r, c in heap}
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr, dc in grid.EIGHT:
            p = (r + dr, c + dc)
            if 0 <= p[0] < n and 0 <= p[1] < n and p not in level:
                level[p] = max(v, z[p[0]][p[1]])
                heapq.heappush(heap, (level[p], *p))
    full = grid.filled(band(spark, z, "z"))
    got = {(r.r, r.c): r.filled for r in full.collect()}
    assert got == level
    flow = grid.drained(full)
    up = grid.flow_accumulation(full.select("cid"), flow)
    assert up.join(flow.where("receiver IS NULL"), "cid").agg(F.sum("cells_up")).first()[0] == n * n


def test_sinks_of_long_chains_and_closed_regions(spark):
    n = 301
    z = [[100.0] * n, [50.0 + (c % 2) * (20 + c / 10) - c / 100 for c in range(n)], [100.0] * n]
    z[1][0], z[1][-1] = 90.0, 95.0
    cells = band(spark, z, "z")
    got = {r.cid: r.filled for r in grid.filled(cells).collect()}
    level, heap = {}, []
    for r in range(3):
        for c in range(n):
            if r in (0, 2) or c in (0, n - 1):
                level[r, c] = z[r][c]
                heap.append((z[r][c], r, c))
    heapq.heapify(heap)
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr, dc in grid.EIGHT:
            p = (r + dr, c + dc)
            if 0 <= p[0] < 3 and 0 <= p[1] < n and p not in level:
                level[p] = max(v, z[p[0]][p[1]])
                heapq.heappush(heap, (level[p], *p))
    assert got == {r * n + c: v for (r, c), v in level.items()}


def test_quantiles_against_numpy(spark):
    import numpy as np

    from cellframe.operators import ranks

    rng = np.random.default_rng(4)
    rows = [(int(k), float(round(v, 1))) for k, v in zip(rng.integers(0, 3, 500), rng.normal(0, 3, 500))] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {(r.k, r.share): r.cut for r in ranks.quantiles(df, "v", [0.0, 0.05, 0.5, 1.0], ["k"]).collect()}
    for k in range(3):
        mine = [v for a, v in rows if a == k and v is not None]
        assert [got[k, q] for q in (0.0, 0.05, 0.5, 1.0)] == pytest.approx([float(np.quantile(mine, q)) for q in (0.0, 0.05, 0.5, 1.0)])
    assert ranks.quantiles(df.where("v IS NULL"), "v", [0.5]).count() == 0
    order = [r.rank for r in ranks.numbered(df, ["k", "v"]).orderBy("k", "v").collect()]
    assert sorted(order) == list(range(1, 502))


def test_splits_are_exact(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    sampled = S.down_sampled(rows, "y", "id", 1.5, 3)
    assert {r.y: r["count"] for r in sampled.groupBy("y").count().collect()} == {1: 200, 0: 300}
    assert sampled.orderBy("id").collect() == S.down_sampled(rows.repartition(7), "y", "id", 1.5, 3).orderBy("id").collect()
    split = S.stratified_split(rows, "y", "id", 0.7, 3)
    assert {(r.y, r.is_train): r["count"] for r in split.groupBy("y", "is_train").count().collect()} == {(1, True): 140, (1, False): 60, (0, True): 560, (0, False): 240}
    cells = band(spark, [[1.0] * 8] * 8)
    assert S.block_split(cells, "g", 4, 0.8, 1).where("is_train").count() == 3
    with pytest.raises(Exception, match="two valid blocks"):
        S.block_split(cells, "g", 8).collect()


def test_patches_and_centres(spark):
    cells = band(spark, [[1.0 if (r + c) % 7 else None for c in range(23)] for r in range(19)])

    def starts(lo, hi, patch, stride):
        if hi - lo < patch:
            return []
        s = list(range(lo, hi - patch + 1, stride))
        return s if s[-1] == hi - patch else [*s, hi - patch]

    values = {(r.r, r.c) for r in cells.where("g IS NOT NULL").collect()}
    for block in (None, 10):
        want = set()
        for b0 in range(0, 19, block or 19):
            for c0 in range(0, 23, block or 23):
                for r in starts(b0, min(b0 + (block or 19), 19), 5, 3):
                    for c in starts(c0, min(c0 + (block or 23), 23), 5, 3):
                        if sum((x, y) in values for x in range(r, r + 5) for y in range(c, c + 5)) / 25 >= 0.85:
                            want.add((r, c))
        assert {(r.r0, r.c0) for r in S.patch_origins(cells, "g", 19, 23, 5, 3, 0.85, block).collect()} == want
    assert S.patch_origins(cells, "g", 19, 23, 20, 3).count() == 0
    labelled = cells.withColumn("y", (F.col("c") % 2).cast("int"))
    centres = S.balanced_centres(labelled, "y", 4000, 2, 19, 23, 5).collect()
    seen = {1: {}, 0: {}}
    for x in centres:
        seen[x.y][x.r, x.c] = seen[x.y].get((x.r, x.c), 0) + 1
    inside = {k: sum(1 for r in range(2, 17) for c in range(2, 21) if c % 2 == k) for k in (0, 1)}
    for k in (0, 1):
        assert sum(seen[k].values()) == 2000 and len(seen[k]) > 0.99 * inside[k] and max(seen[k].values()) < 6 * 2000 / inside[k]
    with pytest.raises(Exception, match="no candidate"):
        S.balanced_centres(labelled.where("y = 0"), "y", 10, 2, 19, 23, 5).collect()


def test_selections_fail_on_nothing(spark):
    none = spark.createDataFrame([], "cid long, pci double")
    for f in (lambda: select.top_percent_cut(none, [10]), lambda: select.top_percent_summary(none, [10], None, 1.0)):
        with pytest.raises(Exception, match="no valid cells"):
            f().collect()
    cells = spark.createDataFrame([(0, 0.1, True), (1, 0.2, True), (2, 0.7, True), (3, 0.9, False)], "cid long, pci double, e boolean")
    got = select.top_percent_summary(cells, [50], F.col("e"), 100.0).first()
    assert (round(got.pci_cutoff, 9), got.source_pixels, got.source_area_m2) == (0.45, 1, 100.0)


def test_flat_bands(spark):
    flat = spark.createDataFrame([(float(5), float(4))] * 3, "a double, b double")
    assert curves.histogram(flat, "a", 4).collect()[0].n == 3
    assert curves.regression_scores(flat, "a", "b").first().r2 is None
    with pytest.raises(ValueError):
        curves.weibull_fit(flat, "a")


def test_samples_repeat(spark):
    a, b = (S.c_samples(spark, 50, 5).collect() for _ in range(2))
    assert a == b and all(15 <= r.r_mm_hr < 55 and r.c > 0 for r in a)
    with pytest.raises(ValueError):
        S.c_samples(spark, 0)


def test_monte_carlo_scores_every_draw(spark, monkeypatch):
    cells = band(spark, [[0.5 * k + 0.1 for k in range(12)], [None, *range(20, 130, 10)]])
    monkeypatch.setattr(queries.B, "cells", lambda *_: cells)
    got = {r.cid: r for r in queries.pci_monte_carlo(spark, "").collect()}
    draws = S.c_samples(spark).collect()
    assert len(draws) == 1500 and len(got) == 23
    few = select.pci_monte_carlo(cells, S.c_samples(spark), na=F.col("cid") * 0 + 0.02)
    for name, value in (("SPLIT", {1: 3, 2: 3}), ("NODES", {1: 12, 2: 12}), ("G_BINS", 2)):
        monkeypatch.setattr(select, name, value)
    each = select.pci_monte_carlo(cells, S.c_samples(spark), na=F.col("cid") * 0 + 0.02)
    by_cid = lambda df: {r.cid: (round(r.pci, 9), round(r.c_mean, 6)) for r in df.collect()}
    assert by_cid(few) == by_cid(each)
    got = {r.cid: r for r in queries.pci_monte_carlo(spark, "").collect()}
    for cell in cells.where("g IS NOT NULL").collect():
        na = 0.01 + 0.001 * (cell.cid % 50)
        c = []
        for d in draws:
            m = d.d50_mm / 1000
            nb = 0.0474 * m ** (1 / 6)
            c.append((0.043 * 9.81 * 1650 * m / (9810 * nb**1.5 * (nb + na) ** -0.9 * (d.r_mm_hr / 1000 / 3600) ** 0.6)) ** (1 / 0.6))
        assert got[cell.cid].pci == round(sum(x <= cell.g for x in c) / 1500, 6)
        assert got[cell.cid].c_mean == pytest.approx(sum(c) / 1500, abs=1e-4)


def test_monte_carlo_of_bands(spark):
    """One, two and three inputs as bands, missing ones, and values at the ends of the model's range."""
    rows = [(k, 0.3 * k if k % 9 else None if k % 2 else 0.0, 0.0004 * (k % 13) if k % 11 else None, -0.01 + 0.01 * (k % 17), (k % 7) * 4e-6) for k in range(120)]
    cells = spark.createDataFrame(rows, "cid long, g double, d double, n double, q double")
    samples = S.c_samples(spark, 60)
    draws = samples.collect()

    def c_of(d, n, q):
        d, n, q = max(d, 1e-12), max(n, 0.0), max(q, 1e-12)
        nb = 0.0474 * d ** (1 / 6)
        return (0.043 * 9.81 * 1650 * d / max(9810 * nb**1.5 * (nb + n) ** -0.9 * q**0.6, 1e-12)) ** (1 / 0.6)

    for names in (["n"], ["d"], ["q"], ["d", "n"], ["n", "q"], ["d", "n", "q"]):
        args = {"d": "d50", "n": "na", "q": "r"}
        got = {r.cid: r for r in select.pci_monte_carlo(cells, samples, **{args[k]: F.col(k) for k in names}).collect()}
        assert set(got) == {r[0] for r in rows if r[1] is not None}
        for cid, g, d, n, q in rows:
            if g is None:
                continue
            if "d" in names and d is None:
                assert got[cid].pci is None and got[cid].c_mean is None
                continue
            c = [c_of(d if "d" in names else x.d50_mm / 1000, n if "n" in names else x.na, q if "q" in names else x.r_mm_hr / 3.6e6) for x in draws]
            assert got[cid].pci == pytest.approx(sum(x <= g for x in c) / 60, abs=1e-12), (names, cid)
            assert got[cid].c_mean == pytest.approx(sum(c) / 60, rel=1e-5 if len(names) == 2 else 1e-7), (names, cid)


def test_weibull_fit(spark):
    draws = spark.range(4000).select((3.0 * F.pow(-F.ln(1 - S.uniform(1, "w", "id")), F.lit(1 / 1.7))).alias("x"))
    shape, scale = curves.weibull_fit(draws, "x")
    assert shape == pytest.approx(1.7, rel=0.05) and scale == pytest.approx(3.0, rel=0.05)


def test_bilinear_renormalises(spark):
    got = scenes.resampled(band(spark, [[1, 3], [None, 5]]), "g", 2.0, 1, 1, "bilinear").first()
    assert got.value == pytest.approx(3.0)


def test_report_without_predictions(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    got = {r["class"]: r for r in curves.classification_report(rows, "y", "p").collect()}
    assert got["1"].precision == 0.0 and got["accuracy"].f1 == 0.5


def test_patches_round_trip(spark):
    """Arrays of patches hold each band, mask and target at its place; averages over patches come back to every valid cell."""
    rng = random.Random(2)
    rows = [(r, c, *(None if rng.random() < 0.1 else rng.random() for _ in range(3))) for r in range(13) for c in range(17)]
    cells = spark.createDataFrame(rows, "r long, c long, a double, b double, y double")
    got = S.patch_arrays(cells, ["a", "b"], "y", 13, 17, 5, 4, 0.3)
    at = {(r, c): v for r, c, *v in rows if None not in v}
    starts = lambda n: sorted({*range(0, n - 4, 4), n - 5})
    want = {(r0, c0): [(r0 + k // 5, c0 + k % 5) for k in range(25)] for r0 in starts(13) for c0 in starts(17)}
    want = {k: v for k, v in want.items() if sum(p in at for p in v) >= 0.3 * 25}
    found = {(r.r0, r.c0): r for r in got.collect()}
    assert set(found) == set(want)
    for k, places in want.items():
        assert found[k].mask == [int(p in at) for p in places]
        assert [found[k].x[0], found[k].x[1], found[k].y] == [[at[p][i] if p in at else 0.0 for p in places] for i in range(3)]
    back = {(r.r, r.c): (r.p, r.n) for r in S.patches_averaged(got.select("r0", "c0", "mask", F.col("y").alias("p")), 5).collect()}
    n = {p: sum(p in v for v in want.values()) for p in at}
    assert back == {p: (pytest.approx(at[p][2]), n[p]) for p in at if n[p]} and len(back) == len(at)
    assert S.patch_arrays(cells.limit(0), ["a"], "y", 13, 17, 5, 4).collect() == []
