"""Queries of the cell operators over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import sampling as S
from ..operators import curves, grid, scenes, select, tiles
from . import bridge as B
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pci_by_rank(B.cells(spark, sf_dir), S.c_samples(spark))


C, SA, SC, Z = B.CELLS, B.SAMPLES, B.SCORED, B.ZONES


def lost():
    return select.eroded("dz", -0.277)


@query(f"WITH {C}, {SA}, {SC}, cuts AS (SELECT 10e0 AS top_percent, quantile_cont(pci, 0.9e0) AS pci_cutoff FROM scored UNION ALL SELECT 5e0, quantile_cont(pci, 0.95e0) FROM scored) "
       "SELECT top_percent, round(pci_cutoff, 6) AS pci_cutoff, count(cid) AS source_pixels, count(cid) * 100e0 AS source_area_m2, count(cid) * 100e0 / 1e6 AS source_area_km2 FROM cuts LEFT JOIN scored ON pci >= pci_cutoff AND dz < -0.277e0 GROUP BY ALL")
def source_top_percent(spark, sf_dir):
    """Eroded cells at or over the cutoff of the top 10 and 5 percent, and their area."""
    return rounded(select.top_percent_summary(scored(spark, sf_dir).select("dz", "pci"), [10, 5], lost(), 100.0), "pci_cutoff")


@query(f"WITH {C}, bands AS (SELECT unnest([5e0, 10e0, 20e0, 30e0, 50e0, 70e0]) AS c_min) SELECT c_min, count(cid) AS source_pixels, count(cid) * 100e0 AS source_area_m2, count(cid) * 100e0 / 1e6 AS source_area_km2 FROM bands LEFT JOIN cells ON g >= c_min AND g < 120 AND dz < -0.277e0 GROUP BY ALL")
def source_c_bands(spark, sf_dir):
    mins = [5.0, 10.0, 20.0, 30.0, 50.0, 70.0]
    chosen = select.c_band_cells(B.cells(spark, sf_dir), mins, 120.0, lost())
    return select.summary_of(chosen, ["c_min"], spark.createDataFrame([(m,) for m in mins], "c_min double"), 100.0)


@query(f"WITH {C}, {SA}, {SC}, cut AS (SELECT quantile_cont(pci, 0.9e0) AS p10, quantile_cont(pci, 0.95e0) AS p5 FROM scored), "
       "t(x, m) AS (VALUES ('top10', NULL), ('top5', NULL), ('cmin5_lt_cmax120_g', 5e0), ('cmin10_lt_cmax120_g', 10e0), ('cmin20_lt_cmax120_g', 20e0), ('cmin30_lt_cmax120_g', 30e0), ('cmin50_lt_cmax120_g', 50e0), ('cmin70_lt_cmax120_g', 70e0)), "
       "n AS (SELECT x, count(*) AS k FROM scored, cut, t WHERE dz < -0.277e0 AND CASE x WHEN 'top10' THEN pci >= p10 WHEN 'top5' THEN pci >= p5 ELSE g >= m AND g < 120 END GROUP BY x) "
       "SELECT x AS label, coalesce(k, 0) AS source_pixels, coalesce(k, 0) * 100e0 AS source_area_m2, coalesce(k, 0) * 100e0 / 1e6 AS source_area_km2 FROM t LEFT JOIN n USING (x)")
def source_area_job(spark, sf_dir):
    """All selections by top percent and by band of the index at once."""
    cells = scored(spark, sf_dir).select("cid", "r", "c", "g", "dz", "pci")
    return jobs.source_areas(cells, [10, 5], [5.0, 10.0, 20.0, 30.0, 50.0, 70.0], 120.0, lost(), 100.0)[1]


@query(f"WITH {C}, {SA}, {SC} SELECT cid, round(pci, 6) AS pci FROM scored")
def pci_rank(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("cid", "pci"), "pci")


@query(f"WITH {C}, {SA}, n AS (SELECT DISTINCT cid % 50 AS k FROM cells), t AS (SELECT k, {B.c_of('(d50_mm / 1000e0)', '(0.01e0 + 0.001e0 * k)', '(r_mm_hr / 1000e0 / 3600e0)')} AS cc FROM n, samples), m AS (SELECT k, avg(cc) AS c_mean FROM t GROUP BY k), p AS (SELECT cid, cid % 50 AS k, count(*) AS n FROM cells JOIN t ON cid % 50 = k AND cc <= g GROUP BY cid) SELECT cid, round(coalesce(n, 0) / 1500e0, 6) AS pci, round(c_mean, 4) AS c_mean FROM cells JOIN m ON cid % 50 = m.k LEFT JOIN p USING (cid) WHERE g IS NOT NULL")
def pci_monte_carlo(spark, sf_dir):
    """Roughness is a band of its own: each of the 1,500 draws is scored in each cell."""
    out = select.pci_monte_carlo(B.cells(spark, sf_dir), S.c_samples(spark), na=0.01 + 0.001 * (F.col("cid") % 50))
    return rounded(rounded(out, "pci"), "c_mean", digits=4)


@query(f"WITH {C}, {SA}, p AS (SELECT cid, avg((cc <= g)::int) AS pci, avg(cc) AS c_mean FROM (SELECT cid, g, {B.c_of('(d50_mm / 1000e0)', '(0.015e0 + 0.08e0 * (dz + 0.5e0))', '(r_mm_hr / 1000e0 / 3600e0)')} AS cc FROM cells, samples WHERE g IS NOT NULL) GROUP BY cid) SELECT cid, round(pci, 6) AS pci, round(c_mean, 4) AS c_mean FROM p")
def pci_monte_carlo_band(spark, sf_dir):
    """Roughness is a continuous band, different in every cell: each of the 1,500 draws counts in each cell."""
    out = select.pci_monte_carlo(B.cells(spark, sf_dir), S.c_samples(spark), na=0.015 + 0.08 * (F.col("dz") + 0.5))
    return rounded(rounded(out, "pci"), "c_mean", digits=4)


@query(f"WITH {C}, {SA}, p AS (SELECT cid, avg((cc <= g)::int) AS pci, avg(cc) AS c_mean FROM (SELECT cid, g, {B.c_of('(0.0005e0 + 0.0001e0 * a)', '(na)', '((15e0 + 40e0 * (dz + 0.5e0)) / 1000e0 / 3600e0)')} AS cc FROM cells, samples WHERE g IS NOT NULL) GROUP BY cid) SELECT cid, round(pci, 6) AS pci, round(c_mean, 4) AS c_mean FROM p")
def pci_monte_carlo_two_bands(spark, sf_dir):
    """Diameter and rate are continuous bands, roughness is drawn."""
    out = select.pci_monte_carlo(B.cells(spark, sf_dir), S.c_samples(spark), d50=0.0005 + 0.0001 * F.col("a"), r=(15.0 + 40.0 * (F.col("dz") + 0.5)) / 1000.0 / 3600.0)
    return rounded(rounded(out, "pci"), "c_mean", digits=4)


@query(f"WITH {C} SELECT cid, round({B.c_of('(0.001e0 + 0.0001e0 * (cid % 30))', '0.03e0', '(45e0 / 1000e0 / 3600e0)')}, 6) AS c, round(a / 10e0, 6) AS spec, round(CASE WHEN g > 0 THEN log10(g) END, 6) AS log_g, CASE WHEN g IS NOT NULL THEN (20e0 <= g)::int::double END AS det FROM cells")
def cell_expressions(spark, sf_dir):
    d = 0.001 + 0.0001 * (F.col("cid") % 30)
    out = B.cells(spark, sf_dir).select("cid", E.threshold_c(d, 0.03, 45.0 / 1000 / 3600).alias("c"), E.specific_area("a", 10.0).alias("spec"), E.safe_log10("g").alias("log_g"), E.deterministic_pci("g", 20.0).alias("det"))
    return rounded(out, "c", "spec", "log_g")


@query(f"WITH {C}, {SA}, {SC} SELECT cid, round(g - ln(greatest(0.001e0, least(pci, 0.999e0)) / (1 - greatest(0.001e0, least(pci, 0.999e0)))) / 0.1e0, 6) AS eff, (pci >= 0.7)::tinyint AS cls, round(1 / (1 + exp(-(0.02e0 * g - 0.5e0 * s - 1e0))), 6) AS prob FROM scored WHERE g IS NOT NULL")
def cell_scores(spark, sf_dir):
    out = scored(spark, sf_dir).where("g IS NOT NULL").select("cid", E.effective_c("g", "pci", 0.1).alias("eff"), E.classified("pci", 0.7).alias("cls"), E.sigmoid(E.linear_score({"g": 0.02, "s": -0.5}, -1.0)).alias("prob"))
    return rounded(out, "eff", "prob")


@query(f"WITH {C}, s AS (SELECT * FROM (VALUES ('low', 20e0), ('mid', 40e0), ('high', 80e0)) t(name, c_model)) SELECT name, c_model, count(cid) AS source_cells, count(cid) * 100e0 AS source_area_m2 FROM s LEFT JOIN cells ON g > c_model GROUP BY ALL")
def sensitivity(spark, sf_dir):
    """Of repeated scenarios the first stays; then cells over each one's threshold."""
    rows = [(0, "low", 20.0), (1, "mid", 40.0), (2, "again", 20.0), (3, "high", 80.0)]
    scenarios = select.first_of_key(spark.createDataFrame(rows, "pos int, name string, c_model double"), ["c_model"], "pos").select("name", "c_model")
    counts = select.scenario_cells(B.cells(spark, sf_dir), scenarios).groupBy("name").agg(F.count("*").alias("source_cells"))
    return scenarios.join(counts, "name", "left").select("name", "c_model", F.coalesce("source_cells", F.lit(0)).alias("source_cells"), (F.coalesce("source_cells", F.lit(0)) * 100.0).alias("source_area_m2"))


@query(f"WITH {C}, {SA}, {SC}, {Z} SELECT zone, round(avg(pci), 6) AS mean_value, round(quantile_cont(pci, 0.5), 6) AS median_value, round(avg((pci > 0.6)::int) * 100, 6) AS percent_gt_0_6, round(avg((pci > 0.7)::int) * 100, 6) AS percent_gt_0_7, count(*) AS n_cells FROM scored JOIN (SELECT cid, zone FROM zones) USING (cid) WHERE pci IS NOT NULL GROUP BY zone")
def zonal(spark, sf_dir):
    cells = select.pci_by_rank(B.zones(spark, sf_dir), S.c_samples(spark))
    return rounded(curves.zonal_statistics(cells, "zone", "pci"), "mean_value", "median_value", "percent_gt_0_6", "percent_gt_0_7")


@query(f"WITH {C} SELECT soil, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS probability, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cells GROUP BY soil")
def soil_distribution(spark, sf_dir):
    return rounded(curves.category_distribution(B.cells(spark, sf_dir), "soil"), "probability", "percent")


@query(f"WITH {C} SELECT count(g) AS n_valid, round(min(g), 6) AS low, round(avg(g), 6) AS mean_value, round(max(g), 6) AS high FROM cells")
def validate_band(spark, sf_dir):
    return rounded(curves.validation(B.cells(spark, sf_dir), "g"), "low", "mean_value", "high")


@query(f"WITH {C} SELECT round(min(g), 6) AS low, round(avg(g), 6) AS mean_value, round(quantile_cont(g, 0.5), 6) AS median_value, round(max(g), 6) AS high FROM cells")
def g_summary(spark, sf_dir):
    return rounded(curves.distribution_summary(B.cells(spark, sf_dir), "g"), "low", "mean_value", "median_value", "high")


@query(f"WITH {C}, k AS (SELECT soil, floor(g) AS v, count(*) AS n_at FROM cells WHERE g IS NOT NULL GROUP BY ALL) SELECT soil, v, n_at, round(sum(n_at) OVER (PARTITION BY soil ORDER BY v) / (sum(n_at) OVER (PARTITION BY soil) + 1), 6) AS p FROM k")
def ecdf_by_soil(spark, sf_dir):
    cells = B.cells(spark, sf_dir).select("soil", F.floor("g").cast("double").alias("v"))
    return rounded(curves.ecdf(cells, ["soil"], "v", "n+1"), "p")


@query(f"WITH {C}, e AS (SELECT min(g) AS lo, max(g) AS hi FROM cells), b AS (SELECT least(39, floor((g - lo) / ((hi - lo) / 40)))::int AS bin, (hi - lo) / 40 AS w FROM cells, e WHERE g IS NOT NULL) SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * any_value(w)), 6) AS density FROM b GROUP BY bin")
def g_histogram(spark, sf_dir):
    return rounded(curves.histogram(B.cells(spark, sf_dir), "g", 40), "density")


@query(f"WITH {C}, {SA}, {SC}, q AS (SELECT cid, greatest(1e-6, least(pci, 1 - 1e-6)) * 1499 AS h FROM scored WHERE pci IS NOT NULL), x AS (SELECT list_sort(list(c)) AS xs FROM samples) SELECT cid, round(xs[floor(h)::int + 1] + (xs[least(floor(h)::int + 2, 1500)] - xs[floor(h)::int + 1]) * (h - floor(h)), 6) AS c_eq FROM q, x")
def c_equivalent(spark, sf_dir):
    cells = scored(spark, sf_dir).where("pci IS NOT NULL")
    return rounded(curves.quantile_of(cells, F.col("pci"), S.c_samples(spark), "c", "c_eq").select("cid", "c_eq"), "c_eq")


@query(f"WITH {C}, p AS (SELECT (dz < -0.277e0)::int AS y, (g >= 50)::int AS yhat FROM cells WHERE g IS NOT NULL) SELECT y, yhat, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    rows = B.cells(spark, sf_dir).where("g IS NOT NULL").select(lost().cast("int").alias("y"), (F.col("g") >= 50).cast("int").alias("yhat"))
    return curves.confusion(rows, "y", "yhat")


@query(f"WITH {C} SELECT round(1 - sum((g - s) * (g - s)) / (var_pop(g) * count(*)), 6) AS r2, round(sqrt(avg((g - s) * (g - s))), 6) AS rmse, round(avg((g - s) * (g - s)), 6) AS mse FROM cells WHERE g IS NOT NULL AND s IS NOT NULL")
def regression(spark, sf_dir):
    return rounded(curves.regression_scores(B.cells(spark, sf_dir), "g", "s"), "r2", "rmse", "mse")


@query(f"WITH {C} SELECT unnest(['a', 'g']) AS feature, unnest([round(quantile_cont(a, 0.5), 6), round(quantile_cont(g, 0.5), 6)]) AS location, unnest([round(stddev_pop(a), 6), round(stddev_pop(g), 6)]) AS scale FROM cells")
def feature_scale(spark, sf_dir):
    return rounded(curves.location_and_scale(B.cells(spark, sf_dir), ["a", "g"], "median"), "location", "scale")


NEAR = """near AS (SELECT x.cid, y.cid AS nid, (x.z - y.z) / CASE WHEN o.dr <> 0 AND o.dc <> 0 THEN sqrt(2e0) ELSE 1e0 END AS drop_, o.k FROM cells x, (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) o(k, dr, dc), cells y WHERE y.r = x.r + o.dr AND y.c = x.c + o.dc),
best AS (SELECT cid, nid AS receiver, drop_ FROM near WHERE drop_ > 0 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY drop_ DESC, k) = 1)"""


@query(f"WITH {C}, {NEAR} SELECT cid, receiver, round(drop_, 6) AS drop, round(drop_ / 10, 6) AS slope FROM best")
def d8_receivers(spark, sf_dir):
    return rounded(tiles.receivers(B.cells(spark, sf_dir), "z", 10.0).drop("k"), "drop", "slope")


@query(f"WITH RECURSIVE {C}, {NEAR}, walk AS (SELECT cid AS origin, cid FROM cells UNION ALL SELECT origin, receiver FROM walk JOIN best USING (cid)) SELECT cid, count(*) AS cells_up FROM walk GROUP BY cid")
def flow_accumulation(spark, sf_dir):
    return tiles.accumulated(grid.kept(tiles.flow_of_descent(B.cells(spark, sf_dir))))


@query(f"WITH RECURSIVE {C}, mask AS (SELECT cid, r, c FROM cells WHERE g >= 55), edge AS (SELECT x.cid, y.cid AS nid FROM mask x JOIN mask y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1), "
       "reach AS (SELECT cid, cid AS to_ FROM mask UNION SELECT reach.cid, nid FROM reach JOIN edge ON edge.cid = reach.to_) SELECT component, count(*) AS n_cells, count(*) * 100e0 AS area_m2 FROM (SELECT cid, min(to_) AS component FROM reach GROUP BY cid) GROUP BY component")
def mask_components(spark, sf_dir):
    parts = grid.components(B.cells(spark, sf_dir).where("g >= 55").select("cid", "r", "c"))
    return grid.component_sizes(parts, 100.0)


@query(f"WITH RECURSIVE {C}, {SA}, {SC}, mask AS MATERIALIZED (SELECT cid, r, c, pci FROM scored WHERE pci >= 0.7e0), edge AS (SELECT x.cid, y.cid AS nid FROM mask x JOIN mask y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1), "
       "step AS MATERIALIZED (SELECT cid, nid FROM edge UNION ALL SELECT cid, cid FROM mask), spread AS (SELECT 0 AS i, cid, cid AS component FROM mask UNION ALL SELECT s.i + 1, e.cid, min(s.component) FROM spread s JOIN step e ON e.nid = s.cid WHERE s.i < 400 GROUP BY s.i, e.cid), "
       "part AS (SELECT component, count(*) AS n_cells, avg(pci) AS m, min(pci) AS lo, max(pci) AS hi FROM (SELECT cid, component FROM spread WHERE i = 400) JOIN mask USING (cid) GROUP BY component HAVING count(*) >= 3) "
       "SELECT component, n_cells, round(m, 6) AS pci_mean, round(lo, 6) AS pci_min, round(hi, 6) AS pci_max, n_cells * 100e0 AS area_m2, n_cells * 100e0 / 1e6 AS area_km2, row_number() OVER (ORDER BY component) AS source_id FROM part")
def pci_polygons(spark, sf_dir):
    """Components of cells with PCI of 0.7 or more, at least 300 m2, with statistics and ids. SQL spreads names 400 times, further than any component of the test grid reaches."""
    cells = scored(spark, sf_dir).select("cid", "r", "c", "pci")
    parts = grid.components(cells.where("pci >= 0.7").select("cid", "r", "c")).join(cells.select("cid", "pci"), "cid")
    return rounded(grid.polygons(parts, 100.0, 300.0, value="pci"), "pci_mean", "pci_min", "pci_max")


@query(f"WITH RECURSIVE {C}, pair AS (SELECT x.cid, y.cid AS nid FROM cells x JOIN cells y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 AND x.cid <> y.cid), edge AS (SELECT cid FROM pair GROUP BY cid HAVING count(*) < 8), "
       "flood AS (SELECT 0 AS i, cid, z, CASE WHEN cid IN (SELECT cid FROM edge) THEN z ELSE 1e9 END AS level FROM cells UNION ALL SELECT f.i + 1, f.cid, f.z, greatest(f.z, least(f.level, n.low)) FROM flood f JOIN (SELECT pair.cid, min(f2.level) AS low FROM pair JOIN flood f2 ON f2.cid = pair.nid GROUP BY pair.cid) n ON n.cid = f.cid WHERE f.i < 120) "
       "SELECT cid, round(level, 6) AS filled FROM flood WHERE i = 120 AND level > z")
def sink_filled(spark, sf_dir):
    """Cells raised by sink filling. SQL lets levels fall 120 times, which is more than the way from any cell of the test grid to its edge."""
    out = grid.filled(B.cells(spark, sf_dir))
    return out.where("filled > z").select("cid", F.round("filled", 6).alias("filled"))


@query(f"WITH {B.SCENES} SELECT cid, round(quantile_cont(value, 0.5), 6) AS value, count(DISTINCT ts) AS n_images FROM scenes WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-16' AND qa & 3 = 0 GROUP BY cid")
def scene_composite(spark, sf_dir):
    clear = B.scenes(spark, sf_dir).where(E.clear_low_bits("qa"))
    return rounded(scenes.composite(clear, "2024-01-01", "2024-01-16", "median"), "value")


@query(f"WITH {B.SCENES} SELECT product, ts::date::varchar AS date, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.5), 6) AS median_value, round(stddev_pop(value), 6) AS std_value, count(*) AS n FROM scenes WHERE value IS NOT NULL GROUP BY ALL")
def scene_series(spark, sf_dir):
    each = B.scenes(spark, sf_dir).withColumn("date", F.to_date("ts").cast("string"))
    return rounded(scenes.time_series(each), "mean_value", "median_value", "std_value")


@query(f"WITH {B.SCENES}, pre AS (SELECT cid, avg(value) AS v FROM scenes WHERE ts < TIMESTAMP '2024-01-16' GROUP BY cid), post AS (SELECT cid, avg(value) AS v FROM scenes WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-02-01' GROUP BY cid) SELECT cid, round(post.v - pre.v, 6) AS value FROM post JOIN pre USING (cid)")
def scene_change(spark, sf_dir):
    s = B.scenes(spark, sf_dir)
    return rounded(scenes.change(scenes.composite(s, "2024-01-16", "2024-02-01", "mean"), scenes.composite(s, "2000-01-01", "2024-01-16", "mean")), "value")


@query(f"WITH {B.SCENES}, m AS (SELECT cid, value, (ts + to_months((event_id % 12)::int)) AS ts FROM scenes) SELECT date_trunc('month', ts)::date::varchar AS month, cid, round(quantile_cont(value, 0.5), 6) AS value FROM m WHERE value IS NOT NULL AND date_trunc('month', ts) BETWEEN DATE '2024-02-01' AND DATE '2024-06-01' GROUP BY ALL")
def scene_monthly(spark, sf_dir):
    spread = B.scenes(spark, sf_dir).withColumn("ts", F.expr("ts + make_ym_interval(0, CAST(event_id % 12 AS INT))"))
    return rounded(scenes.monthly_median(spread, "2024-01-15", "2024-06-01").withColumn("month", F.col("month").cast("string")), "value")


@query(f"WITH {B.SCENES} SELECT cid, round(arg_max(value, (ts, value)), 6) AS value FROM scenes WHERE value IS NOT NULL GROUP BY cid")
def scene_mosaic(spark, sf_dir):
    return rounded(scenes.mosaic(B.scenes(spark, sf_dir)), "value")


@query(f"WITH {B.SCENES} SELECT cid, ts, round(value, 6) AS value FROM scenes WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) <= 3 * 86400000000 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')), ts, value) = 1")
def scene_closest(spark, sf_dir):
    return rounded(scenes.closest(B.scenes(spark, sf_dir), "2024-01-15", 3), "value")


@query(f"WITH {C} SELECT r // 2 AS r, c // 2 AS c, round(avg(g), 6) AS value FROM cells WHERE r < (SELECT max(r) // 2 * 2 FROM cells) GROUP BY ALL")
def resample_average(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    half = (B.height(spark, sf_dir) - 1) // 2
    return rounded(scenes.resampled(cells, "g", 2.0, half, B.WIDTH // 2, "average"), "value")


@query(f"WITH {C} SELECT r * 50 + c AS tile, round(value, 6) AS value FROM (SELECT r // 2 AS r, c // 2 AS c, g AS value FROM cells WHERE r % 2 = 1 AND c % 2 = 1 AND r < (SELECT max(r) // 2 * 2 FROM cells))")
def resample_nearest(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    half = (B.height(spark, sf_dir) - 1) // 2
    return rounded(scenes.resampled(cells, "g", 2.0, half, B.WIDTH // 2).select((F.col("r") * 50 + F.col("c")).alias("tile"), "value"), "value")


LITHO = [("a", [[(2.2, 1.3), (40.6, 3.1), (30.4, 13.7), (5.1, 12.2)], [(10.3, 4.2), (20.1, 4.4), (15.2, 9.6)]]), ("b", [[(50.5, 0.2), (90.7, 14.1), (60.2, 11.9)]])]
_edges = ", ".join(f"('{p}', {ring[k][0]}e0, {ring[k][1]}e0, {ring[(k + 1) % len(ring)][0]}e0, {ring[(k + 1) % len(ring)][1]}e0)" for p, rings in LITHO for ring in rings for k in range(len(ring)))


@query(f"WITH {C}, e(poly_id, x0, y0, x1, y1) AS (VALUES {_edges}) SELECT poly_id, cid FROM cells, e WHERE (y0 <= r + 0.5e0) <> (y1 <= r + 0.5e0) AND x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) > c + 0.5e0 GROUP BY ALL HAVING count(*) % 2 = 1")
def point_in_zone(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    rings = spark.createDataFrame([(p, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for p, rings in LITHO], "poly_id string, rings array<array<struct<x:double,y:double>>>")
    return scenes.in_polygons(B.height(spark, sf_dir), rings, cells)


@query(f"WITH {C}, y AS (SELECT cid, (dz < -0.277e0)::int AS y, {B._u('negative', 'cid')} AS u FROM cells WHERE g IS NOT NULL), k AS (SELECT count(*) FILTER (y = 1) AS n FROM y) SELECT cid, y FROM (SELECT cid, y, row_number() OVER (PARTITION BY y ORDER BY u, cid) AS place FROM y), k WHERE y = 1 OR place <= n")
def balanced_sample(spark, sf_dir):
    rows = B.cells(spark, sf_dir).where("g IS NOT NULL").select("cid", lost().cast("int").alias("y"))
    return S.down_sampled(rows, "y", "cid", 1.0, 42)


BLOCK = "(br || ':' || bc)"


@query(f"WITH {C}, b AS (SELECT r // 16 AS br, c // 16 AS bc, count(*) AS n_cells FROM cells WHERE g IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY {B._u('block', BLOCK)}) AS place, count(*) OVER () AS n FROM b) SELECT br, bc, n_cells, place <= greatest(1, least(n - 1, round(n * 0.8e0))) AS is_train FROM o")
def split_blocks(spark, sf_dir):
    return S.block_split(B.cells(spark, sf_dir), "g", 16, 0.8, 42)


@query(f"WITH {C}, e AS (SELECT x.cid AS src, y.cid AS dst FROM cells x JOIN cells y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1 WHERE x.g IS NOT NULL AND y.g IS NOT NULL), n AS (SELECT cid, g FROM cells WHERE g IS NOT NULL), "
       "one AS (SELECT cid, coalesce(m, 0) AS g1 FROM n LEFT JOIN (SELECT dst, avg(g) AS m FROM e JOIN n ON n.cid = src GROUP BY dst) ON dst = cid), two AS (SELECT cid, coalesce(m, 0) AS g2 FROM n LEFT JOIN (SELECT dst, avg(g1) AS m FROM e JOIN one ON one.cid = src GROUP BY dst) ON dst = cid) SELECT cid AS id, round(g1, 6) AS g_1, round(g2, 6) AS g_2 FROM one JOIN two USING (cid)")
def neighbour_means(spark, sf_dir):
    """Means over the neighbours, and of these means over the neighbours again."""
    cells = B.cells(spark, sf_dir).where("g IS NOT NULL")
    return rounded(tiles.neighbour_means(cells, "g", 2).select("id", "g_1", "g_2"), "g_1", "g_2")
