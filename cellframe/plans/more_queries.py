"""Further queries: targets, feature tables, labels, zones, polygons and splits, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import sampling as S
from ..operators import curves, features, forests, grid, layers, models, scenes, select, tiles
from ..operators.ranks import numbered
from ..operators.shared import new_path
from ..operators.warp import Grid, warped
from ..sources import tables
from . import bridge as B
from . import jobs
from .config import job_settings
from .queries import C, LITHO, SA, SC, lost, query, rounded, scored

U = B._u


@query(f"WITH {C}, t AS (SELECT cid, a * 10e0 AS da, a, s, g, dz FROM cells) SELECT cid, CASE WHEN s > 0 AND da > 0 AND g > 0 AND g < 120 AND dz IS NOT NULL THEN (dz < -0.277e0 AND g >= 20)::int END AS physics_dod, CASE WHEN s > 0 AND da > 0 AND g > 0 AND g < 120 AND dz IS NOT NULL THEN (dz < -0.277e0)::int END AS dod_only, CASE WHEN s > 0 AND da > 0 AND g IS NOT NULL AND dz IS NOT NULL THEN (dz < -0.277e0 AND g >= 20 AND g < 120)::int END AS in_band, CASE WHEN coalesce(g < 60, true) THEN round(s, 6) END AS no_channel FROM t")
def targets(spark, sf_dir):
    cells = B.cells(spark, sf_dir).withColumn("da", E.drainage_area("a", 10.0))
    names = {"physics_dod": features.target_physics(), "dod_only": features.target_change(), "in_band": features.target_in_band(), "no_channel": F.round(E.without_channels("s", "g", 60.0), 6)}
    return cells.select("cid", *[c.alias(n) for n, c in names.items()])


@query(f"WITH {C} SELECT cid, (dz < -0.277e0 AND g >= 20 AND g < 120)::int AS y, round(s, 6) AS s, round(log10(a * 10e0), 6) AS log_da, round(embedding[1]::double, 6) AS e1 FROM cells JOIN embeddings ON vec_id = cid % 500 WHERE s > 0 AND a > 0 AND g IS NOT NULL AND dz IS NOT NULL")
def feature_table(spark, sf_dir):
    """Cells with a target and three features, one of them from a layer of its own; one that doesn't exist is left out."""
    cells = B.cells(spark, sf_dir).withColumn("da", E.drainage_area("a", 10.0)).withColumn("log_da", E.safe_log10("da"))
    layer = cells.select("cid", (F.col("cid") % 500).alias("vec_id")).join(B.table(spark, sf_dir, "embeddings"), "vec_id").select("cid", F.get("embedding", F.lit(0)).cast("double").alias("e1"))
    out = features.assembled(cells, {"e1": layer}, ["s", "log_da", "e1", "nowhere"], features.target_in_band(), "skip")
    return rounded(out, "s", "log_da", "e1")


_bands = ", ".join(f"round(embedding[{k}]::double, 6) AS band_{k:02d}" for k in range(1, 17))


@query(f"SELECT vec_id AS cid, {_bands} FROM embeddings")
def band_table(spark, sf_dir):
    out = features.band_columns(B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cid"), "embedding"), "embedding")
    return rounded(out, *[c for c in out.columns if c != "cid"])


@query("SELECT event_id, round((v * 2.75e-5 - 0.2e0 - (w * 2.75e-5 - 0.2e0)) / nullif(v * 2.75e-5 - 0.2e0 + (w * 2.75e-5 - 0.2e0), 0), 6) AS ndvi, (qa >> 3) & 1 = 0 AND (qa >> 4) & 1 = 0 AS clear, round(v * 0.1e0, 6) AS lai, round(greatest(-20, least(20, v / 1000e0 - 15e0)), 6) AS clipped FROM (SELECT event_id, (event_id % 32)::int AS qa, 10000e0 + 50e0 * value AS v, 9000e0 + user_id::double AS w FROM events)")
def scene_indices(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 32).cast("int").alias("qa"), (10000.0 + 50.0 * F.col("value")).alias("v"), (9000.0 + F.col("user_id").cast("double")).alias("w"))
    out = rows.select("event_id", E.normalized_difference("v", "w").alias("ndvi"), E.clear_cloud_bits("qa").alias("clear"), E.leaf_area("v").alias("lai"), E.clipped(F.col("v") / 1000.0 - 15.0, -20.0, 20.0, 0.0).alias("clipped"))
    return rounded(out, "ndvi", "lai", "clipped")


def _g(x: str) -> str:
    return f"format('{{:g}}', {x})"


@query(f"WITH v AS (SELECT o_orderkey AS cid, (o_orderkey % 97 - 48) / 8e0 AS x FROM orders) SELECT cid, 'top' || replace({_g('abs(x)')}, '.', 'p') AS top, 'cmin' || replace(replace({_g('x')}, '-', 'minus'), '.', 'p') || '_lt_cmax' || replace({_g('x + 50')}, '.', 'p') || '_g' AS band, 'erosion_mask_dod_lt_' || CASE WHEN x < 0 THEN 'minus_' ELSE 'plus_' END || replace({_g('abs(x)')}, '.', 'p') || 'm' AS erosion FROM v")
def label_names(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"), ((F.col("o_orderkey") % 97 - 48) / 8.0).alias("x"))
    return rows.select("cid", E.top_label(F.abs("x")).alias("top"), E.band_label("x", F.col("x") + 50).alias("band"), E.erosion_label("x").alias("erosion"))


@query("SELECT o_orderkey AS cid, round(o_totalprice / 1e5 / 1000e0, 12) AS d50_mm, round(o_totalprice / 1e5, 9) AS d50_m, round(o_totalprice / 1e4 / 1000e0 / 3600e0, 16) AS rain, round(o_totalprice / 1e4, 9) AS rain_other, CASE o_orderpriority WHEN '1-URGENT' THEN 'clay' WHEN '2-HIGH' THEN 'silt' ELSE 'unknown' END AS texture FROM orders")
def units_and_codes(spark, sf_dir):
    p = F.col("o_totalprice")
    named = E.looked_up("o_orderpriority", {"1-URGENT": "clay", "2-HIGH": "silt"})
    rows = B.table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("cid"), F.round(E.converted(p / 1e5, "d50", {"units": "MM"}), 12).alias("d50_mm"), F.round(E.converted(p / 1e5, "d50", {"max_mm": 3}), 9).alias("d50_m"), F.round(E.converted(p / 1e4, "rainfall_excess", {"units": "mm per hour"}), 16).alias("rain"), F.round(E.converted(p / 1e4, "rainfall_excess", {"max_mm_hr": 9}), 9).alias("rain_other"), named.alias("texture"))


_edges = ", ".join(f"('{p}', {ring[k][0]}e0, {ring[k][1]}e0, {ring[(k + 1) % len(ring)][0]}e0, {ring[(k + 1) % len(ring)][1]}e0)" for p, rings in LITHO for ring in rings for k in range(len(ring)))
INSIDE = f"e(poly_id, x0, y0, x1, y1) AS (VALUES {_edges}), inside AS (SELECT poly_id, cid FROM cells, e WHERE (y0 <= r + 0.5e0) <> (y1 <= r + 0.5e0) AND x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) > c + 0.5e0 GROUP BY ALL HAVING count(*) % 2 = 1)"


def litho(spark):
    return spark.createDataFrame([(p, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for p, rings in LITHO], "poly_id string, rings array<array<struct<x:double,y:double>>>")


def inside(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    return cells, scenes.in_polygons(B.height(spark, sf_dir), litho(spark), cells)


@query(f"WITH {C}, {INSIDE} SELECT poly_id, count(*) AS pixel_count, count(*) * 100e0 AS area_m2, count(*) * 100e0 / 1e6 AS area_km2 FROM inside JOIN cells USING (cid) WHERE g IS NOT NULL GROUP BY poly_id")
def zone_pixels(spark, sf_dir):
    cells, member = inside(spark, sf_dir)
    return scenes.polygon_pixels(member, cells, "g", 100.0)


@query(f"WITH {C}, {INSIDE} SELECT DISTINCT cid, r, c FROM cells JOIN inside USING (cid) WHERE poly_id IN ('b') OR (poly_id = 'a' AND dz < -0.277e0)")
def zones_clipped_and_dissolved(spark, sf_dir):
    """Cells of zone b, and eroded cells clipped to zone a, as one layer."""
    cells, member = inside(spark, sf_dir)
    one, other = (cells.join(scenes.in_zones(member, [k]), "cid", "left_semi") for k in "ab")
    return scenes.dissolved(scenes.clipped_to(cells.where(lost()), one), other)


@query(f"WITH {C} SELECT DISTINCT soil FROM cells WHERE soil IS NOT NULL")
def soil_classes(spark, sf_dir):
    return scenes.classes_of(B.cells(spark, sf_dir), "soil")


REACH = "edge AS (SELECT x.cid, y.cid AS nid FROM mask x JOIN mask y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1), reach AS (SELECT cid, cid AS to_ FROM mask UNION SELECT reach.cid, nid FROM reach JOIN edge ON edge.cid = reach.to_), named AS (SELECT cid, min(to_) AS component FROM reach GROUP BY cid)"


@query(f"WITH RECURSIVE {C}, mask AS (SELECT cid, r, c FROM cells WHERE g >= 55), {REACH} SELECT component, count(*) AS n_cells, count(*) * 100e0 AS area_m2 FROM named GROUP BY component ORDER BY n_cells DESC, component LIMIT 4")
def largest_polygons(spark, sf_dir):
    parts = grid.components(B.cells(spark, sf_dir).where("g >= 55").select("cid", "r", "c"))
    return scenes.largest(grid.component_sizes(parts, 100.0))


@query(f"WITH RECURSIVE {C}, mask AS (SELECT cid, r, c FROM cells WHERE g >= 55), {REACH}, side AS (SELECT component, cid, r, c, d FROM named JOIN mask USING (cid), (VALUES (0), (1), (2), (3)) t(d)), open_ AS (SELECT s.* FROM side s WHERE NOT EXISTS (SELECT 1 FROM named n JOIN mask m USING (cid) WHERE n.component = s.component AND m.r = s.r + CASE d WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AND m.c = s.c + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)), area AS (SELECT component, count(*) AS n FROM named GROUP BY component), around AS (SELECT component, count(*) AS m FROM open_ GROUP BY component) SELECT component, n * 1e0 AS area, m AS outline FROM area JOIN around USING (component)")
def polygon_outlines(spark, sf_dir):
    """Area within each polygon's traced rings, less its holes, and their length; SQL counts cells and open sides."""
    parts = grid.components(B.cells(spark, sf_dir).where("g >= 55").select("cid", "r", "c"))
    shapes = grid.outlines(grid.outline_points(parts))
    follow = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    ring = lambda r: F.aggregate(F.zip_with(r, follow(r), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, v: s + v)
    return shapes.select("component", E.polygon_area("rings").alias("area"), F.aggregate("rings", F.lit(0.0), lambda s, r: s + ring(r)).cast("long").alias("outline"))


_SEL = """sel AS (SELECT 'top10' AS label, 'pci_top_percent_dod' AS method, 10e0 AS top_percent, (SELECT quantile_cont(pci, 0.9e0) FROM scored) AS pci_cutoff, NULL::double AS c_min, NULL::double AS c_max
  UNION ALL SELECT 'top5', 'pci_top_percent_dod', 5e0, (SELECT quantile_cont(pci, 0.95e0) FROM scored), NULL, NULL
  UNION ALL SELECT 'cmin' || m || '_lt_cmax120_g', 'c_band_dod', NULL, NULL, m::double, 120e0 FROM (SELECT unnest([5, 10, 20, 30, 50, 70]) AS m)),
mask AS (SELECT label, cid, r, c FROM scored, sel WHERE dz < -0.277e0 AND (pci >= pci_cutoff OR g >= c_min AND g < c_max)),
edge AS (SELECT x.label, x.cid, y.cid AS nid FROM mask x JOIN mask y ON x.label = y.label AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1),
reach AS (SELECT label, cid, cid AS to_ FROM mask UNION SELECT reach.label, reach.cid, nid FROM reach JOIN edge ON edge.cid = reach.to_ AND edge.label = reach.label),
part AS (SELECT label, component, count(*) * 100e0 AS area_m2 FROM (SELECT label, cid, min(to_) AS component FROM reach GROUP BY label, cid) GROUP BY label, component)"""


@query(f"WITH RECURSIVE {C}, {SA}, {SC}, {_SEL} SELECT label, component, row_number() OVER (PARTITION BY label ORDER BY component) AS source_id, row_number() OVER (PARTITION BY label ORDER BY component) AS mass__wasting_id, top_percent, round(pci_cutoff, 6) AS pci_cutoff, c_min, c_max, -0.277e0 AS dod_thresh, method, area_m2, area_m2 / 1e6 AS area_km2 FROM part JOIN sel USING (label)")
def source_area_polygons(spark, sf_dir):
    """Source polygons of all selections with their attributes."""
    cells = scored(spark, sf_dir).select("cid", "r", "c", "g", "dz", "pci")
    return rounded(jobs.source_area_workflow(cells, job_settings(), 100.0)["polygons"], "pci_cutoff")


@query(f"WITH RECURSIVE {C}, {SA}, {SC}, {_SEL}, k AS (SELECT label, count(*) AS n FROM mask GROUP BY label), p AS (SELECT label, count(*) AS n_polygons, sum(area_m2) AS area FROM part WHERE area_m2 >= 400 GROUP BY label) SELECT c_min, c_max, true AS dod_filter, -0.277e0 AS dod_threshold_m, coalesce(n_polygons, 0) AS n_polygons, coalesce(area, 0e0) AS polygon_area_m2, coalesce(area, 0e0) / 1e6 AS polygon_area_km2, label FROM sel LEFT JOIN p USING (label) WHERE c_min IS NOT NULL")
def source_area_polygon_summary(spark, sf_dir):
    """Polygons of at least 400 m2 of each band, bands without any too."""
    cells = scored(spark, sf_dir).select("cid", "r", "c", "g", "dz", "pci")
    return jobs.source_area_workflow(cells, job_settings({"source_area": {"min_polygon_area_m2": 400.0}}), 100.0)["c_band_polygon_rows"]


@query(f"WITH {C}, y AS (SELECT cid, (dz < -0.277e0)::int AS y, {U('split', 'cid')} AS u FROM cells WHERE g IS NOT NULL) SELECT cid, y, row_number() OVER (PARTITION BY y ORDER BY u, cid) <= round(count(*) OVER (PARTITION BY y) * 0.7e0) AS is_train FROM y")
def stratified_cells(spark, sf_dir):
    rows = B.cells(spark, sf_dir).where("g IS NOT NULL").select("cid", lost().cast("int").alias("y"))
    return S.stratified_split(rows, "y", "cid", 0.7, 42)


@query(f"WITH {C} SELECT cid, {U('cells', 'cid')} < 0.8e0 AS is_train FROM cells")
def random_cells(spark, sf_dir):
    return S.random_split(B.cells(spark, sf_dir).select("cid"), "cid", 0.8, 42)


@query(f"WITH {C}, h AS (SELECT max(r) + 1 AS h FROM cells), s AS (SELECT r0 FROM h, (SELECT unnest(range(0, 20000, 8)) AS r0) WHERE r0 + 16 <= h UNION SELECT h - 16 FROM h WHERE h >= 16), t AS (SELECT unnest(range(0, 85, 8)) AS c0 UNION SELECT 84) SELECT r0::bigint AS r0, c0::bigint AS c0, round(count(g) / 256e0, 6) AS valid FROM s, t, cells WHERE r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY ALL HAVING count(g) / 256e0 >= 0.97e0")
def patch_grid(spark, sf_dir):
    cells = B.cells(spark, sf_dir)
    return rounded(S.patch_origins(cells, "g", B.height(spark, sf_dir), B.WIDTH, 16, 8, 0.97), "valid")


@query(f"WITH {C}, v AS (SELECT 'all' AS label, floor(g) AS v FROM cells UNION ALL SELECT 'eroded', floor(g) FROM cells WHERE dz < -0.277e0), k AS (SELECT label, v, count(*) AS n_at FROM v WHERE v > 1 GROUP BY ALL) SELECT label, v, n_at, round(sum(n_at) OVER (PARTITION BY label ORDER BY v) / sum(n_at) OVER (PARTITION BY label), 6) AS p FROM k")
def curves_by_label(spark, sf_dir):
    cells = B.cells(spark, sf_dir).select("dz", F.floor("g").cast("double").alias("v"))
    return rounded(curves.curve_family({"all": cells, "eroded": cells.where(lost())}, "v", "n", 1.0), "p")


def _ratio(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0)::double, 0e0)"


_one = " UNION ALL ".join(f"SELECT '{k}' AS class, {_ratio(f'count(*) FILTER (y = {k} AND p = {k})', f'count(*) FILTER (p = {k})')} AS precision, {_ratio(f'count(*) FILTER (y = {k} AND p = {k})', f'count(*) FILTER (y = {k})')} AS recall, count(*) FILTER (y = {k}) AS support FROM yp" for k in (0, 1))


@query(f"WITH {C}, yp AS (SELECT (dz < -0.277e0)::int AS y, (g >= 50)::int AS p FROM cells WHERE g IS NOT NULL), one AS ({_one}), two AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1 FROM one), three AS (SELECT class, precision, recall, f1, support FROM two UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM two UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM two UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg((y = p)::int) AS a, count(*) AS n FROM yp)) SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::bigint AS support FROM three")
def class_report(spark, sf_dir):
    rows = B.cells(spark, sf_dir).where("g IS NOT NULL").select(lost().cast("int").alias("y"), (F.col("g") >= 50).cast("int").alias("p"))
    return rounded(curves.classification_report(rows, "y", "p"), "precision", "recall", "f1")


_curves = [("fine", 1.0, 0.02, 0.05, 20.0, 40.0), ("coarse", 4.0, 0.05, 0.10, 15.0, 55.0)]
_values = ", ".join(f"('{x[0]}', {', '.join(f'{v}e0' for v in x[1:])})" for x in _curves)


LABELLED = "(label || ':' || i)"


@query(f"WITH {C}, n AS (SELECT cid AS i FROM cells), t(label, d, na0, na1, r0, r1) AS (VALUES {_values}), v AS (SELECT label, i, d, na0 + (na1 - na0) * {U('na', LABELLED)} AS na, r0 + (r1 - r0) * {U('r', LABELLED)} AS r FROM n, t) SELECT label, i, d AS d50_mm, round(na, 9) AS na, round(r, 9) AS r_mm_hr, round({B.c_of('(d / 1000e0)', 'na', '(r / 1000e0 / 3600e0)')}, 6) AS c FROM v")
def curve_draws(spark, sf_dir):
    """As many draws of two curves as there are cells."""
    n = B.table(spark, sf_dir, "orders").count()
    return rounded(rounded(S.curve_samples(spark, _curves, n, 42), "c"), "na", "r_mm_hr", digits=9)


@query(f"WITH {C}, {SA}, {SC} SELECT cid, round(count_ / 1500e0, 6) AS pci FROM (SELECT cid, (SELECT count(*) FROM samples WHERE samples.c <= cells.g) AS count_ FROM cells WHERE g IS NOT NULL)")
def pci_of_counts(spark, sf_dir):
    """Counts of draws at or below the index, by the table of sorted draws, made into shares."""
    cells = B.cells(spark, sf_dir).where("g IS NOT NULL")
    table = S.c_samples(spark).agg(F.array_sort(F.array_agg("c")).alias("cs"))
    return cells.crossJoin(F.broadcast(table)).select("cid", F.round(E.pci_from_count(select.count_at_most("cs", F.col("g")), 1500), 6).alias("pci"))


@query(f"WITH {C} SELECT cid, round(a * power(greatest(s - 0.3e0, 0e0), 1.167e0), 6) AS g FROM cells")
def driving_index(spark, sf_dir):
    return rounded(B.cells(spark, sf_dir).select("cid", E.driving_index("a", F.col("s") - 0.3).alias("g")), "g")


@query(f"WITH {C} SELECT r, c, round(g::float::double, 4) AS g FROM cells")
def band_round_trip(spark, sf_dir):
    """A band written as tiles of 32-bit floats, once, and read back; missing cells stay missing."""
    cells, path = B.cells(spark, sf_dir), new_path(spark)
    tables.write_band(cells, path, "g")
    return rounded(tables.read_band(spark, path, "g"), "g", digits=4)


@query(f"WITH {C} SELECT r, c, (dz < -0.277e0)::int::smallint AS m FROM cells WHERE g IS NOT NULL UNION ALL SELECT r, c, NULL FROM cells WHERE g IS NULL")
def mask_round_trip(spark, sf_dir):
    """A mask of three values written and read back through a dataset that is built once."""
    path = new_path(spark)
    mask = B.cells(spark, sf_dir).select("r", "c", F.when(F.col("g").isNotNull(), lost()).alias("m"))
    tables.write_mask(mask, path, "m")
    return tables.reused(spark, path, lambda: mask)


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0")
def valid_bands(spark, sf_dir):
    return tables.all_bands_valid(B.table(spark, sf_dir, "embeddings"), "embedding").select("vec_id")


@query(f"WITH {C} SELECT cid AS i, round(g, 6) AS \"C\" FROM cells WHERE g > 0")
def samples_csv(spark, sf_dir):
    """Samples written as CSV and read back without missing, infinite and non-positive ones."""
    path = new_path(spark)
    tables.write_rows(B.cells(spark, sf_dir).select(F.col("cid").alias("i"), F.col("g").alias("C")), path)
    return rounded(tables.read_samples(spark, path).select(F.col("i").cast("long").alias("i"), "C"), "C")


@query(f"WITH RECURSIVE {C}, mask AS (SELECT cid, r, c FROM cells WHERE g >= 55), {REACH} SELECT component, count(*) * 1e0 AS area, 'a' AS tag FROM named GROUP BY component HAVING count(*) >= 3 UNION ALL SELECT component, count(*) * 1e0, NULL FROM named GROUP BY component HAVING count(*) = 2")
def layers_joined(spark, sf_dir):
    """Polygons written as two GeoJSON layers, read back as one, and measured."""
    parts = grid.components(B.cells(spark, sf_dir).where("g >= 55").select("cid", "r", "c"))
    shapes = grid.outlines(grid.outline_points(parts)).withColumn("area", E.polygon_area("rings"))
    one, other = new_path(spark), new_path(spark)
    tables.write_geojson(shapes.where("area >= 3").withColumn("tag", F.lit("a")), one)
    tables.write_geojson(shapes.where("area = 2"), other)
    paths = []
    for path, schema in ((one, "component long, tag string"), (other, "component long")):
        paths.append(new_path(spark))
        tables.write_layer(tables.read_geojson(spark, path, schema, lines=True), paths[-1])
    return tables.read_layers(spark, paths).select("component", E.polygon_area("rings").alias("area"), "tag")


def training_cells(spark, sf_dir):
    cells = B.cells(spark, sf_dir).withColumn("da", E.drainage_area("a", 10.0)).withColumn("log_da", E.safe_log10("da"))
    return features.assembled(cells, {}, ["s", "log_da", "z"], features.target_change(cutoff=1e9))


@query()
def logistic_coefficients(spark, sf_dir):
    """Coefficients of a balanced logistic model of eroded cells, fitted on a stratified 70 percent. Tested against a Newton solve."""
    rows = S.stratified_split(training_cells(spark, sf_dir), "y", "cid", 0.7, 42)
    return models.coefficients(rows, models.logistic(rows.where("is_train"), "y", ["s", "log_da", "z"]))


@query()
def logistic_scores(spark, sf_dir):
    """Held-out cells with their probability and class."""
    rows = S.stratified_split(training_cells(spark, sf_dir), "y", "cid", 0.7, 42)
    return models.held_out(models.scored(rows, models.logistic(rows.where("is_train"), "y", ["s", "log_da", "z"])), "y")


@query()
def forest_importance(spark, sf_dir):
    rows, names = training_cells(spark, sf_dir), ["s", "log_da", "z"]
    return models.importances(rows, models.forest(rows, "y", names, trees=20, depth=6), names)


@query()
def embedding_scores(spark, sf_dir):
    """A regression of the driving index on the 64 bands of each cell."""
    bands = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = B.cells(spark, sf_dir).withColumn("vec_id", F.col("cid") % 500).join(bands, "vec_id").select("cid", "g", "embedding")
    return features.embedding_regression(S.random_split(cells, "cid", 0.8, 42), "embedding", "g")[1].select("cid", "g", "is_train", F.round("said", 6).alias("said"))


@query()
def graph_scores(spark, sf_dir):
    """A logistic model of slope and area and of their means over two rings of the flow graph."""
    rows = training_cells(spark, sf_dir)
    flow = tiles.receivers(B.cells(spark, sf_dir)).select(F.col("cid").alias("src"), F.col("receiver").alias("dst"))
    nodes = rows.select(F.col("cid").alias("id"), "s", "log_da", "y")
    return features.graph_classifier(nodes, flow, "y", ["s", "log_da"])[1].select("id", "y", F.round("prob_source", 9).alias("prob_source"), "pred_source")


@query()
def weibull_of_index(spark, sf_dir):
    shape, scale = curves.weibull_fit(B.cells(spark, sf_dir), "g")
    return spark.createDataFrame([(round(shape, 6), round(scale, 6))], "shape double, scale double")


OUTLINED = f"""mask AS MATERIALIZED (SELECT cid, r, c FROM scored WHERE pci >= 0.7e0), link AS (SELECT x.cid, y.cid AS nid FROM mask x JOIN mask y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1),
    hop AS MATERIALIZED (SELECT cid, nid FROM link UNION ALL SELECT cid, cid FROM mask), named AS (SELECT 0 AS i, cid, cid AS component FROM mask UNION ALL SELECT s.i + 1, e.cid, min(s.component) FROM named s JOIN hop e ON e.nid = s.cid WHERE s.i < 400 GROUP BY s.i, e.cid),
    part AS MATERIALIZED (SELECT component, r, c FROM named JOIN mask USING (cid) WHERE i = 400 AND component IN (SELECT component FROM named WHERE i = 400 GROUP BY component HAVING count(*) >= 3)),
    way(k, dx0, dy0, dx1, dy1, dr, dc) AS (VALUES (0,0,0,1,0,-1,0), (1,1,0,1,1,0,1), (2,1,1,0,1,1,0), (3,0,1,0,0,0,-1)),
    side AS MATERIALIZED (SELECT p.component, k, p.c + dx0 AS x0, p.r + dy0 AS y0, p.c + dx1 AS x1, p.r + dy1 AS y1, ((p.r + dy0) * 4294967296 + p.c + dx0) * 4 + k AS id FROM part p, way WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.component = p.component AND q.r = p.r + dr AND q.c = p.c + dc)),
    follow AS MATERIALIZED (SELECT a.id, b.id AS next, a.k <> b.k AS turned FROM side a JOIN side b ON a.component = b.component AND a.x1 = b.x0 AND a.y1 = b.y0 WHERE (b.k - a.k + 4) % 4 <> 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY CASE (b.k - a.k + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) = 1),
    trip AS (SELECT id AS start, id, 0 AS n FROM side UNION ALL SELECT start, next, n + 1 FROM trip JOIN follow USING (id) WHERE next <> start),
    lead AS MATERIALIZED (SELECT start FROM trip GROUP BY start HAVING min(id) = start),
    corner AS MATERIALIZED (SELECT component, start AS ring, n, x0 AS x, y0 AS y FROM trip JOIN lead USING (start) JOIN side USING (id) WHERE id IN (SELECT next FROM follow WHERE turned)),
    ringed AS (SELECT component, ring, string_agg(x || ' ' || y, ', ' ORDER BY n) || ', ' || arg_min(x || ' ' || y, n) AS text, sum(x * ny - nx * y) / 2e0 AS area, sum(abs(x - nx) + abs(y - ny))::double AS length, count(*) AS n_corners
        FROM (SELECT *, coalesce(lead(x) OVER o, first(x) OVER o) AS nx, coalesce(lead(y) OVER o, first(y) OVER o) AS ny FROM corner WINDOW o AS (PARTITION BY component, ring ORDER BY n)) GROUP BY component, ring)"""


def high_points(spark, sf_dir):
    cells = scored(spark, sf_dir).where("pci >= 0.7").select("cid", "r", "c")
    parts = grid.kept(grid.components(cells))
    return grid.outline_points(parts.join(grid.component_sizes(parts, 100.0, 300.0).select("component"), "component", "left_semi"))


@query(f"WITH RECURSIVE {C}, {SA}, {SC}, {OUTLINED} SELECT component, 'POLYGON (' || string_agg('(' || text || ')', ', ' ORDER BY area < 0, ring) || ')' AS geometry FROM ringed GROUP BY component")
def pci_polygon_geometry(spark, sf_dir):
    """Outlines of the polygons of ``pci_polygons`` as text: corners in order, holes after their shell."""
    return grid.run_texts(grid.ring_runs(high_points(spark, sf_dir)))


@query(f"WITH RECURSIVE {C}, {SA}, {SC}, {OUTLINED} SELECT component, ring, area < 0 AS hole, area, length FROM ringed")
def pci_ring_measures(spark, sf_dir):
    """Area and length of each ring, from runs of eight corners."""
    return grid.run_measures(grid.ring_runs(high_points(spark, sf_dir), 8))


CONTACTS = f"""area AS MATERIALIZED (SELECT cid, r, c FROM cells WHERE g >= 30),
    line AS MATERIALIZED (SELECT c + 0.3e0 AS x0, r + 0.2e0 AS y0, c + 0.3e0 + 60e0 * dz AS x1, r + 0.2e0 + 20e0 * s AS y1 FROM cells WHERE cid % 97 = 0 AND s IS NOT NULL),
    tall AS (SELECT *, unnest(range(greatest(floor(least(y0, y1) - 0.5e0)::bigint + 1, 0), floor(greatest(y0, y1) - 0.5e0)::bigint + 1)) AS r FROM line WHERE y0 <> y1),
    wide AS (SELECT *, unnest(range(greatest(floor(least(x0, x1) - 0.5e0)::bigint + 1, 0), floor(greatest(x0, x1) - 0.5e0)::bigint + 1)) AS c FROM line WHERE x0 <> x1),
    cut AS MATERIALIZED (SELECT DISTINCT r, floor(x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) - 0.5e0)::bigint AS c, 0 AS down FROM tall UNION SELECT DISTINCT (CASE WHEN y1 <> y0 AND (y1 > y0) = (x1 > x0) THEN ceil(y0 + (c + 0.5e0 - x0) * (y1 - y0) / (x1 - x0) - 0.5e0) - 1 ELSE floor(y0 + (c + 0.5e0 - x0) * (y1 - y0) / (x1 - x0) - 0.5e0) END)::bigint, c, 1 FROM wide),
    touch AS MATERIALIZED (SELECT a.cid, b.cid AS nid FROM area a JOIN area b ON b.r = a.r AND b.c = a.c + 1 LEFT JOIN cut ON cut.r = a.r AND cut.c = a.c AND down = 0 WHERE down IS NULL
        UNION ALL SELECT a.cid, b.cid FROM area a JOIN area b ON b.r = a.r + 1 AND b.c = a.c LEFT JOIN cut ON cut.r = a.r AND cut.c = a.c AND down = 1 WHERE down IS NULL),
    step AS MATERIALIZED (SELECT cid, nid FROM touch UNION ALL SELECT nid, cid FROM touch UNION ALL SELECT cid, cid FROM area),
    spread AS (SELECT 0 AS i, cid, cid AS component FROM area UNION ALL SELECT s.i + 1, e.cid, min(s.component) FROM spread s JOIN step e ON e.nid = s.cid WHERE s.i < 700 GROUP BY s.i, e.cid)"""


@query(f"WITH RECURSIVE {C}, {CONTACTS} SELECT component, count(*) AS n_cells, count(*) * 100e0 AS area_m2 FROM spread WHERE i = 700 GROUP BY component")
def contact_parts(spark, sf_dir):
    """Parts of an area between contact lines, which cut between cells: lines start at every 97th cell. SQL spreads names 700 times, more than the test grid needs."""
    cells = B.cells(spark, sf_dir)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("c") + 0.3, F.col("r") + 0.2
    lines = cells.where("cid % 97 = 0 AND s IS NOT NULL").select(F.array(point(x, y), point(x + 60.0 * F.col("dz"), y + 20.0 * F.col("s"))).alias("points"))
    return grid.component_sizes(grid.divided(cells.where("g >= 30"), lines, B.height(spark, sf_dir), B.WIDTH), 100.0)


def relief(directions: int) -> str:
    """SQL of the terrain stage: sinks filled, ways by steepest descent and over flats to the nearest way down, cells gathered along them.

    Levels fall 120 times and flats are crossed 60 cells wide, more than the test grid needs.
    """
    straight = "" if directions == 8 else " AND (y.r = x.r OR y.c = x.c)"
    return f"""round_ AS MATERIALIZED (SELECT x.cid, y.cid AS nid, row_number() OVER (PARTITION BY x.cid ORDER BY y.r, y.c) AS k, CASE WHEN y.r <> x.r AND y.c <> x.c THEN sqrt(2e0) ELSE 1e0 END AS dist, y.r = x.r OR y.c = x.c AS straight
        FROM cells x JOIN cells y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 AND x.cid <> y.cid),
    edge AS MATERIALIZED (SELECT cid FROM round_ GROUP BY cid HAVING count(*) < 8),
    flood AS (SELECT 0 AS i, cid, z, CASE WHEN cid IN (SELECT cid FROM edge) THEN z ELSE 1e9 END AS level FROM cells UNION ALL
        SELECT f.i + 1, f.cid, f.z, greatest(f.z, least(f.level, n.low)) FROM flood f JOIN (SELECT round_.cid, min(f2.level) AS low FROM round_ JOIN flood f2 ON f2.cid = round_.nid GROUP BY round_.cid) n ON n.cid = f.cid WHERE f.i < 120),
    full_ AS MATERIALIZED (SELECT cid, level FROM flood WHERE i = 120),
    near AS MATERIALIZED (SELECT p.cid, p.nid, p.k, a.level = b.level AS flat, (a.level - b.level) / p.dist AS drop_ FROM round_ p JOIN full_ a ON a.cid = p.cid JOIN full_ b ON b.cid = p.nid {"" if directions == 8 else "WHERE straight"}),
    steep AS MATERIALIZED (SELECT cid, nid AS receiver, drop_ FROM near WHERE drop_ > 0 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY drop_ DESC, k) = 1),
    done AS MATERIALIZED (SELECT cid FROM steep UNION SELECT cid FROM edge),
    across AS MATERIALIZED (SELECT cid, nid, k FROM near WHERE flat AND cid NOT IN (SELECT cid FROM done)),
    front AS (SELECT 0 AS i, cid FROM done UNION SELECT i + 1, across.cid FROM front JOIN across ON nid = front.cid WHERE i < 60),
    far AS MATERIALIZED (SELECT cid, min(i) AS d FROM front GROUP BY cid),
    ways AS MATERIALIZED (SELECT cid, receiver FROM steep UNION ALL SELECT a.cid, a.nid FROM across a JOIN far x ON x.cid = a.cid JOIN far y ON y.cid = a.nid AND y.d = x.d - 1 QUALIFY row_number() OVER (PARTITION BY a.cid ORDER BY a.k) = 1),
    walk AS (SELECT cid AS origin, cid FROM cells UNION ALL SELECT origin, receiver FROM walk JOIN ways USING (cid)),
    up AS (SELECT cid, count(*) AS n FROM walk GROUP BY cid),
    relief AS MATERIALIZED (SELECT cid, level AS filled, n * 10e0 AS a, coalesce(drop_, 0) / 10e0 AS s, n * 10e0 * power(coalesce(drop_, 0) / 10e0, 1.167e0) AS g FROM full_ JOIN up USING (cid) LEFT JOIN steep USING (cid))"""


@query(f"WITH RECURSIVE {C}, {relief(8)}, {SA} SELECT cid, filled, a, round(s, 6) AS s, round(g, 6) AS g, round((SELECT count(*) FROM samples WHERE samples.c <= relief.g) / 1500e0, 6) AS pci FROM relief")
def terrain_pci_job(spark, sf_dir):
    """The whole job from elevation to scored cells: sinks, flow, slope, area, index, probability."""
    cells = B.cells(spark, sf_dir).select("cid", "r", "c", "z")
    return rounded(jobs.pci_job(cells, S.c_samples(spark), 10.0)[0].select("cid", "filled", "a", "s", "g", "pci"), "s", "g", "pci")


JOB = {"terrain": {"flow_director": "D4"}, "inputs": {"d50": {"mode": "constant", "value_mm": 2.0}, "na": {"mode": "raster", "units": "manning"}}}


@query(f"WITH RECURSIVE {C}, {relief(4)}, {SA}, each AS (SELECT relief.cid, relief.g, {B.c_of('0.002e0', '(0.015e0 + 0.08e0 * (dz + 0.5e0))', '((15e0 + 40e0 * rain) / 1000e0 / 3600e0)')} AS cc FROM relief JOIN cells USING (cid), (SELECT {U('rainfall_excess')} AS rain FROM draws)) SELECT cid, round(avg((cc <= g)::int), 6) AS pci, round(avg(cc), 4) AS c_model_mean FROM each GROUP BY cid")
def settings_job(spark, sf_dir):
    """The job as its settings say it: four directions, a constant diameter, roughness from a raster, a drawn rate; written and read again."""
    cells = B.cells(spark, sf_dir)
    settings = job_settings(JOB, new_path(spark))
    band = cells.select("r", "c", (0.015 + 0.08 * (F.col("dz") + 0.5)).alias("value"))
    found = jobs.run_job(cells.select("cid", "r", "c", "z"), settings, (10.0, -10.0), {"na": band})["cells"]
    return rounded(rounded(found.select("cid", "pci", "c_model_mean"), "pci"), "c_model_mean", digits=4)


@query(f"WITH RECURSIVE {C}, {relief(8)}, {SA}, own AS (SELECT {B.c_of('(d50_mm / 1000e0)', 'na', '((15e0 + 40e0 * ' + U('rainfall_excess') + ') / 1000e0 / 3600e0)')} AS cc FROM draws), s AS (SELECT r, c, (SELECT count(*) FROM own WHERE cc <= relief.g) / 1500e0 AS pci, relief.s FROM relief JOIN cells USING (cid)) SELECT r, c, round(s::float::double, 5) AS slope, round(pci::float::double, 5) AS pci FROM s")
def settings_job_written(spark, sf_dir):
    """Bands of a job with default settings, read from where its settings say that they are written."""
    settings = job_settings({"outputs": {"pci": "own/pci"}}, new_path(spark))
    places = jobs.write_job(jobs.run_job(B.cells(spark, sf_dir).select("cid", "r", "c", "z"), settings, (10.0, 10.0)), settings)
    return tables.read_bands(spark, {n: places[n] for n in ("slope", "pci")}).select("r", "c", F.round("slope", 5).alias("slope"), F.round("pci", 5).alias("pci"))


PATCH, STRIDE = 16, 12
STARTS = lambda x, size: f"list_distinct(list_concat(range(0, {size} - {PATCH} + 1, {STRIDE}), [{size} - {PATCH}]))"
COVERED = f"""size AS (SELECT max(r) + 1 AS h FROM cells), origin AS (SELECT r0, c0 FROM (SELECT unnest({STARTS('r', 'h')}) AS r0 FROM size), (SELECT unnest({STARTS('c', '100')}) AS c0)),
    inner_ AS MATERIALIZED (SELECT r0, c0, r, c, g, s, dz FROM origin JOIN cells ON r BETWEEN r0 AND r0 + {PATCH - 1} AND c BETWEEN c0 AND c0 + {PATCH - 1} WHERE g IS NOT NULL AND s IS NOT NULL AND dz IS NOT NULL)"""


@query(f"WITH {C}, {COVERED}, whole AS (SELECT r0, c0, sum(g) AS g, sum(s) AS s, sum(dz) AS y, count(*) AS n FROM inner_ GROUP BY ALL) SELECT r0::bigint AS r0, c0::bigint AS c0, round(g, 2) AS g, round(s, 3) AS s, round(y, 3) AS y, n::bigint AS n, 256 AS places FROM whole WHERE n >= 128")
def patch_sums(spark, sf_dir):
    """Patches of two bands as arrays with mask and target: what each array holds in all."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    rows = S.patch_arrays(B.cells(spark, sf_dir), ["g", "s"], "dz", B.height(spark, sf_dir), B.WIDTH, PATCH, STRIDE)
    out = rows.select("r0", "c0", total(F.get("x", F.lit(0))).alias("g"), total(F.get("x", F.lit(1))).alias("s"), total(F.col("y")).alias("y"), F.aggregate("mask", F.lit(0).cast("long"), lambda t, v: t + v).alias("n"), F.size(F.get("x", F.lit(1))).alias("places"))
    return rounded(rounded(out, "s", "y", digits=3), "g", digits=2)


@query(f"WITH {C}, {COVERED}, whole AS (SELECT *, avg(g) OVER (PARTITION BY r0, c0) AS m, count(*) OVER (PARTITION BY r0, c0) AS k FROM inner_) SELECT r::bigint AS r, c::bigint AS c, round(avg(g - m), 6) AS p, count(*) AS n FROM whole WHERE k >= 128 GROUP BY r, c")
def patch_round_trip(spark, sf_dir):
    """A patch says of each of its cells how far the index lies from the patch's mean; overlapping patches are averaged back to cells."""
    rows = S.patch_arrays(B.cells(spark, sf_dir), ["g", "s"], "dz", B.height(spark, sf_dir), B.WIDTH, PATCH, STRIDE)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v)
    mean = add(F.get("x", F.lit(0))) / F.aggregate("mask", F.lit(0), lambda t, v: t + v)
    said = rows.select("r0", "c0", "mask", E.let(mean, lambda m: F.transform(F.get("x", F.lit(0)), lambda v: v - m)).alias("p"))  # one mean for a patch, not for a cell
    return rounded(S.patches_averaged(said, PATCH), "p")


@query(f"WITH {C}, {B.SCENES} SELECT product, count(*) AS n, round(sum(value), 4) AS total FROM scenes WHERE cid IN (SELECT cid FROM cells WHERE g >= 60) GROUP BY product")
def scenes_in_area(spark, sf_dir):
    """Scenes of the cells of an area, the cells of a high index."""
    inside = scenes.in_area(B.scenes(spark, sf_dir), B.cells(spark, sf_dir).where("g >= 60"))
    return rounded(inside.groupBy("product").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query(f"WITH {C} SELECT cid, round(g, 6) AS g, round(e, 6) AS e FROM (SELECT cid, g, embedding[2]::double AS e FROM cells JOIN embeddings ON vec_id = cid % 500) WHERE g IS NOT NULL")
def bands_aligned(spark, sf_dir):
    """Two bands of one grid side by side, of the cells that the first band's template has."""
    cells = B.cells(spark, sf_dir)
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", F.get("embedding", F.lit(1)).cast("double").alias("e"))
    place = [F.lit("a").alias("grid_id"), "r", "c"]
    other = cells.join(vectors, F.col("cid") % 500 == F.col("vec_id")).select(*place, "e")
    height = B.height(spark, sf_dir)
    headers = spark.createDataFrame([("a", b, height, B.WIDTH, 10.0) for b in ("g", "e")], "grid_id string, band string, height long, width long, dx double")
    met = scenes.aligned(cells.select(*place, "cid", "g"), other, headers)
    return rounded(scenes.same_template(met, cells.select("cid", "g"), "g").select("cid", "g", "e"), "g", "e")


@query(f"WITH {C}, inner_ AS (SELECT r, c, (dz < -0.277e0)::int AS y FROM cells, (SELECT max(r) + 1 AS h FROM cells) WHERE r BETWEEN 8 AND h - 9 AND c BETWEEN 8 AND 91), ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY r, c) - 1 AS nth, count(*) OVER (PARTITION BY y) AS k FROM inner_), draws AS (SELECT i, i % 2 AS y, {U('centre')} AS u FROM (SELECT unnest(range(2000)) AS i)) SELECT i, y::int AS y, r::bigint AS r, c::bigint AS c FROM draws JOIN ranked USING (y) WHERE nth = floor(u * k)")
def patch_centres(spark, sf_dir):
    """2,000 centres of patches, half of them eroded."""
    rows = B.cells(spark, sf_dir).select("r", "c", lost().cast("int").alias("y"))
    return S.balanced_centres(rows, "y", 2000, 8, B.height(spark, sf_dir), B.WIDTH, 42)


@query(f"WITH RECURSIVE {C}, size AS (SELECT max(r) AS h FROM cells), mask AS (SELECT cid FROM cells WHERE g IS NULL OR g < 45), rest AS MATERIALIZED (SELECT cid, r, c FROM cells WHERE cid NOT IN (SELECT cid FROM mask)), link AS (SELECT x.cid, y.cid AS nid FROM rest x JOIN rest y ON abs(x.r - y.r) + abs(x.c - y.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1), "
       "open_ AS (SELECT cid FROM rest, size WHERE r = 0 OR r = h OR c = 0 OR c = 99 UNION SELECT nid FROM open_ JOIN link USING (cid)) SELECT cid FROM cells WHERE cid NOT IN (SELECT cid FROM open_)")
def mask_without_holes(spark, sf_dir):
    """Cells of a low index and the islands of a high one among them that don't touch the grid's edge."""
    cells = B.cells(spark, sf_dir)
    return grid.without_holes(cells.where("g IS NULL OR g < 45").select("cid", "r", "c"), B.height(spark, sf_dir), B.WIDTH).select("cid")


@query(f"WITH {C}, k AS (SELECT quantile_cont(a, 0.5) AS ma, stddev_pop(a) AS sa, quantile_cont(s, 0.5) AS ms, stddev_pop(s) AS ss FROM cells) SELECT cid, round((coalesce(a, ma) - ma) / sa, 6) + 0e0 AS a, round((coalesce(s, ms) - ms) / ss, 6) + 0e0 AS s FROM cells, k")
def features_scaled(spark, sf_dir):
    """Missing features become the median, then all are centred and scaled."""
    out = rounded(curves.imputed_and_scaled(B.cells(spark, sf_dir).select("cid", "a", "s"), ["a", "s"]), "a", "s")
    return out.select("cid", (F.col("a") + 0.0).alias("a"), (F.col("s") + 0.0).alias("s"))  # no zero with a sign


@query(f"WITH {C} SELECT soil, round(avg(g), 4)::varchar AS mean_value, count(*)::varchar AS n FROM cells WHERE g IS NOT NULL GROUP BY soil")
def summary_csv(spark, sf_dir):
    """A summary written as one CSV file with its columns in order, and read back."""
    path = new_path(spark)
    each = B.cells(spark, sf_dir).where("g IS NOT NULL").groupBy("soil").agg(F.count("*").alias("n"), F.round(F.avg("g"), 4).alias("mean_value"))
    tables.write_rows(each, path, ["soil", "mean_value", "n"], one_file=True)
    return spark.read.option("header", True).csv(path)


@query(f"WITH {B.SCENES} SELECT product, date, n::varchar AS n, (row_number() OVER (ORDER BY product, date))::bigint AS place FROM (SELECT product, ts::date::varchar AS date, count(*) AS n FROM scenes WHERE value IS NOT NULL GROUP BY ALL)")
def series_csv(spark, sf_dir):
    """A time series written as sorted CSV files and read back: rows follow one another over the files."""
    path = new_path(spark)
    each = B.scenes(spark, sf_dir).where("value IS NOT NULL").groupBy("product", F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("n"))
    tables.write_sorted(each, path, ["product", "date"])
    rows = spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name")).withColumn("at", F.monotonically_increasing_id())
    return numbered(rows, ["file", "at"], "place").select("product", "date", "n", "place")


#: Plots of customers in degrees: (ring, corner, east, north) of four corners and of a hole's three, in thousandths.
PLOT = [(0, 0, 0.0, 0.0), (0, 1, 0.9, 0.05), (0, 2, 0.8, 0.85), (0, 3, 0.05, 0.7), (1, 0, 0.3, 0.3), (1, 1, 0.5, 0.3), (1, 2, 0.4, 0.5)]


def _utm(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """The projection's series in SQL, of degrees."""
    a, e2 = 6378137.0, 0.00669437999014132
    ep2 = e2 / (1 - e2)
    phi, lam = f"radians({lat})", f"radians({lon} - ({zone} * 6 - 183))"
    n, t, c = f"({a!r}::double / sqrt(1 - {e2!r}::double * sin({phi}) ** 2))", f"(tan({phi}) ** 2)", f"({ep2!r}::double * cos({phi}) ** 2)"
    aa = f"({lam} * cos({phi}))"
    m = f"({a!r}::double * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r}::double * {phi} - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r}::double * sin(2 * {phi}) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r}::double * sin(4 * {phi}) - {35 * e2**3 / 3072!r}::double * sin(6 * {phi})))"
    x = f"(0.9996e0 * {n} * ({aa} + (1 - {t} + {c}) * {aa} ** 3 / 6e0 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {ep2!r}::double) * {aa} ** 5 / 120e0) + 500000e0)"
    y = f"(0.9996e0 * ({m} + {n} * tan({phi}) * ({aa} ** 2 / 2e0 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * {aa} ** 4 / 24e0 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {ep2!r}::double) * {aa} ** 6 / 720e0)))"
    return x, y


_corners = ", ".join(f"({r}, {k}, {x}e0, {y}e0)" for r, k, x, y in PLOT)
_x, _y = _utm("lon", "lat", "zone")


@query(f"WITH plot(ring, k, dx, dy) AS (VALUES {_corners}), corner AS (SELECT c_custkey, ring, k, -119.6e0 + 0.001e0 * (c_custkey % 100 + dx) AS lon, 34.4e0 + 0.001e0 * (c_custkey // 100 + dy) AS lat FROM customer, plot WHERE ring = 0 OR c_custkey % 3 = 0), "
       "zoned AS (SELECT *, floor(((SELECT (min(lon) + max(lon)) / 2 FROM corner) + 180) / 6)::int + 1 AS zone FROM corner), nexts AS (SELECT *, coalesce(lead(lon) OVER w, first(lon) OVER w) AS lon1, coalesce(lead(lat) OVER w, first(lat) OVER w) AS lat1 FROM zoned WINDOW w AS (PARTITION BY c_custkey, ring ORDER BY k)), "
       f"fine AS (SELECT c_custkey, ring, zone, k * 8 + j AS k, lon + (lon1 - lon) * (j / 8e0) AS lon, lat + (lat1 - lat) * (j / 8e0) AS lat FROM nexts, (SELECT unnest(range(8)) AS j)), metres AS (SELECT c_custkey, ring, zone, k, {_x} AS x, {_y} AS y FROM fine), "
       "home AS (SELECT *, x - first(x) OVER w AS u, y - first(y) OVER w AS v FROM metres WINDOW w AS (PARTITION BY c_custkey, ring ORDER BY k)), turned AS (SELECT *, coalesce(lead(u) OVER w, first(u) OVER w) AS u1, coalesce(lead(v) OVER w, first(v) OVER w) AS v1 FROM home WINDOW w AS (PARTITION BY c_custkey, ring ORDER BY k)), "
       "area AS (SELECT c_custkey, zone, ring, abs(sum(u * v1 - u1 * v)) / 2 AS a FROM turned GROUP BY ALL) SELECT c_custkey, zone, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END), 3) AS area_m2 FROM area GROUP BY c_custkey, zone")
def geographic_plots(spark, sf_dir):
    """A plot in degrees for each customer, a third of them with a hole, measured in the zone of the whole layer."""
    lon, lat = (lambda d: -119.6 + 0.001 * (F.col("c_custkey") % 100 + d)), (lambda d: 34.4 + 0.001 * (F.floor(F.col("c_custkey") / 100) + d))
    ring = lambda n: F.array(*[F.struct(lon(x).alias("x"), lat(y).alias("y")) for r, _, x, y in PLOT if r == n])
    layer = B.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.array(ring(0), ring(1))).otherwise(F.array(ring(0))).alias("rings"))
    return rounded(layers.geographic_areas(layer).select("c_custkey", "zone", "area_m2"), "area_m2", digits=3)


def _degrees(height: int) -> Grid:
    """The given grid, laid out in degrees with slightly turned axes."""
    return Grid(height, B.WIDTH, -119.75, 34.45, 0.0003, -0.00027, 0.000002, 0.000001)


def _metres(height: int, size: float) -> Grid:
    """A grid in metres over the same ground, of cells ``size`` wide."""
    return Grid(max(1, round(height * 30 / size)), round(2700 / size), 247461.3, 3815870.7, size, -size, 0.027 * size, -0.026 * size, zone=11)


def _placed(corner: str, size: float) -> str:
    """SQL that takes ``to_(r, c)`` of the metres to ``met(r, c, k, y, x)`` on the degrees, of the places ``(k, i, j)`` in a cell."""
    a, e2 = 6378137.0, 0.00669437999014132
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    num = lambda v: f"({v!r}::double)"
    turn = 0.0003 * -0.00027 - 0.000002 * 0.000001
    return (f"ends_(k, i, j) AS (VALUES {corner}), xy AS (SELECT r, c, k, 247461.3e0 + {num(size)} * (c + j) + {num(0.027 * size)} * (r + i) AS x, 3815870.7e0 + {num(-0.026 * size)} * (c + j) + {num(-size)} * (r + i) AS y FROM to_, ends_), "
            f"arc AS (SELECT *, y / 0.9996e0 / {num(a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))} AS mu FROM xy), "
            f"foot AS (SELECT *, mu + {num(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu) + {num(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu) + {num(151 * e1**3 / 96)} * sin(6 * mu) + {num(1097 * e1**4 / 512)} * sin(8 * mu) AS p FROM arc), "
            f"curved AS (SELECT *, {num(a)} / sqrt(1 - {num(e2)} * sin(p) ** 2) AS n1, {num(a * (1 - e2))} / (1 - {num(e2)} * sin(p) ** 2) ** 1.5e0 AS r1, tan(p) ** 2 AS t, {num(ep2)} * cos(p) ** 2 AS q FROM foot), away AS (SELECT *, (x - 500000e0) / (n1 * 0.9996e0) AS d FROM curved), "
            f"geo AS (SELECT r, c, k, degrees(p - n1 * tan(p) / r1 * (d ** 2 / 2e0 - (5 + 3 * t + 10 * q - 4 * q * q - 9 * {num(ep2)}) * d ** 4 / 24e0 + (61 + 90 * t + 298 * q + 45 * t * t - 252 * {num(ep2)} - 3 * q * q) * d ** 6 / 720e0)) - 34.45e0 AS v, "
            f"degrees((d - (1 + 2 * t + q) * d ** 3 / 6e0 + (5 - 2 * q + 28 * t - 3 * q * q + 8 * {num(ep2)} + 24 * t * t) * d ** 5 / 120e0) / cos(p)) - 117e0 + 119.75e0 AS u FROM away), "
            f"met AS (SELECT r, c, k, (0.0003e0 * v - 0.000001e0 * u) / {num(turn)} AS y, (-0.00027e0 * u - 0.000002e0 * v) / {num(turn)} AS x FROM geo)")


def _to(size: float) -> str:
    return f"to_ AS (SELECT r, c FROM (SELECT unnest(range((SELECT greatest(1, round_even((max(r) + 1) * 30 / {size!r}::double, 0))::bigint FROM cells))) AS r), (SELECT unnest(range({round(2700 / size)})) AS c))"


_on = "y >= 0 AND y < h AND x >= 0 AND x < 100"


@query(f"WITH {C}, size AS (SELECT max(r) + 1 AS h FROM cells), {_to(25.0)}, {_placed('(0, 0.5e0, 0.5e0)', 25.0)} SELECT met.r, met.c, CASE WHEN {_on} THEN round(z, 9) END AS value FROM size, met LEFT JOIN cells ON cells.r = floor(y)::bigint AND cells.c = floor(x)::bigint")
def warp_nearest(spark, sf_dir):
    """Elevation on a grid in degrees, brought to a turned grid in metres: the cell below each centre."""
    height = B.height(spark, sf_dir)
    return rounded(warped(B.cells(spark, sf_dir), "z", _degrees(height), _metres(height, 25.0)), "value", digits=9)  # elevations have eight digits: none is a tie


@query(f"WITH {C}, size AS (SELECT max(r) + 1 AS h FROM cells), to_ AS (SELECT r, c FROM cells WHERE g >= 30 AND c < 108 AND r < (SELECT round_even((max(r) + 1) * 30 / 25e0, 0) FROM cells)), {_placed('(0, 0.5e0, 0.5e0)', 25.0)}, four AS (SELECT r, c, y, x, floor(y - 0.5e0)::bigint + a AS sr, floor(x - 0.5e0)::bigint + b AS sc FROM met, size, (VALUES (0), (1)) AS p(a), (VALUES (0), (1)) AS q(b) WHERE {_on}), "
       "weighed AS (SELECT four.r, four.c, sum(w * g) / nullif(sum(w), 0) AS value FROM (SELECT *, (1 - abs(y - 0.5e0 - sr)) * (1 - abs(x - 0.5e0 - sc)) AS w FROM four) AS four JOIN cells ON cells.r = sr AND cells.c = sc WHERE g IS NOT NULL GROUP BY ALL) SELECT to_.r, to_.c, round(value, 4) AS value FROM to_ LEFT JOIN weighed USING (r, c)")
def warp_bilinear(spark, sf_dir):
    """The index on a grid in degrees, brought to a template's cells of a turned grid in metres: the four cells around each centre."""
    height, cells = B.height(spark, sf_dir), B.cells(spark, sf_dir)
    return rounded(warped(cells, "g", _degrees(height), _metres(height, 25.0), "bilinear", cells.where("g >= 30")), "value", digits=4)


@query(f"WITH {C}, size AS (SELECT max(r) + 1 AS h FROM cells), {_to(75.0)}, {_placed('(0, 0e0, 0e0), (1, 0e0, 1e0), (2, 1e0, 0e0), (3, 1e0, 1e0)', 75.0)}, box AS (SELECT r, c, greatest(min(y), 0) AS y0, least(max(y), any_value(h)) AS y1, greatest(min(x), 0) AS x0, least(max(x), 100) AS x1 FROM met, size GROUP BY r, c), "
       "rows_ AS (SELECT *, unnest(range(floor(y0)::bigint, ceil(y1)::bigint)) AS sr FROM box WHERE y0 < y1 AND x0 < x1), each_ AS (SELECT *, unnest(range(floor(x0)::bigint, ceil(x1)::bigint)) AS sc FROM rows_), "
       "mean AS (SELECT e.r, e.c, sum(g * w) / sum(w) AS value FROM (SELECT *, (least(y1, sr + 1e0) - greatest(y0, sr::double)) * (least(x1, sc + 1e0) - greatest(x0, sc::double)) AS w FROM each_) AS e JOIN cells ON cells.r = sr AND cells.c = sc WHERE g IS NOT NULL GROUP BY ALL) SELECT to_.r, to_.c, round(value, 4) AS value FROM to_ LEFT JOIN mean USING (r, c)")
def warp_average(spark, sf_dir):
    """The index on a grid in degrees, averaged over the cells of a coarser, turned grid in metres."""
    height = B.height(spark, sf_dir)
    return rounded(warped(B.cells(spark, sf_dir), "g", _degrees(height), _metres(height, 75.0), "average"), "value", digits=4)


#: Choices of the search below: 60 of their 432 combinations are tried.
SEARCH = {"trees": [3, 5, 8], "depth": [2, 4, 6], "split": [2, 5, 10], "leaf": [1, 2, 4, 8], "subset": ["sqrt", "all"], "classes": ["balanced", "balanced_subsample"]}


@query()
def forest_search(spark, sf_dir):
    """60 settings of a forest by F1 over three folds, all grown together. Tested against plain trees."""
    settings = [forests.Setting(**one) for one in features.sampled_grid(SEARCH, 60, 42)]
    table = forests.searched(training_cells(spark, sf_dir), "y", ["s", "log_da", "z"], "cid", settings)
    return rounded(table, "mean_score", "std_score", digits=9)
