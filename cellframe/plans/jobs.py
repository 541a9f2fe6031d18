"""End-to-end jobs made of the cell operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sampling
from ..functions.expr import converted, driving_index
from ..operators import grid, select, tiles
from ..sources import tables
from .config import Settings


def source_areas(cells: DataFrame, percents: list[float], c_mins: list[float], c_max: float | None, erosion: Column, cell_area: float, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen cells of all selections, with ``label``, and a summary row of each selection, empty ones too.

    ``cells`` carry ``pci`` and ``g``. Selections by top percent and by band of
    the index are rows of one small table (``selection_table``), so cells are
    read once for the cutoffs and once for all selections.
    """
    table = selection_table(cells, percents, c_mins, c_max, None) if table is None else table
    in_band = (F.col("g") >= F.col("c_min")) & (F.col("c_max").isNull() | (F.col("g") < F.col("c_max")))
    rules = table.select("label", "pci_cutoff", "c_min", "c_max")
    chosen = cells.where(erosion).join(F.broadcast(rules), (F.col("pci") >= F.col("pci_cutoff")) | in_band).select("label", "cid", "r", "c", "pci")
    return chosen, select.summary_of(chosen, ["label"], table.select("label"), cell_area)


def selection_table(cells: DataFrame, percents: list[float], c_mins: list[float], c_max: float | None, threshold: float | None) -> DataFrame:
    """``(label, top_percent, pci_cutoff, c_min, c_max, dod_thresh, method)``: a row for each selection; ``threshold`` None: no erosion filter."""
    spark, kind = cells.sparkSession, "no_dod" if threshold is None else "dod"
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    cuts = select.top_percent_cut(cells, percents).select(select.top_label("top_percent").alias("label"), "top_percent", "pci_cutoff", number(None).alias("c_min"), number(None).alias("c_max"), F.lit(f"pci_top_percent_{kind}").alias("method"))
    bands = spark.createDataFrame([(float(c),) for c in c_mins], "c_min double").withColumn("c_max", number(c_max))
    bands = bands.select(select.band_label("c_min", "c_max").alias("label"), number(None).alias("top_percent"), number(None).alias("pci_cutoff"), "c_min", "c_max", F.lit(f"c_band_{kind}").alias("method"))
    return cuts.unionByName(bands).select("label", "top_percent", "pci_cutoff", "c_min", "c_max", number(threshold).alias("dod_thresh"), "method")


def source_area_workflow(cells: DataFrame, settings: Settings, cell_area: float) -> dict[str, DataFrame]:
    """The selections of ``settings.source_area`` over scored cells (``cid, r, c, g, dz, pci``), all at once.

    Gives ``cells`` (chosen cells by label), ``polygons`` with ids and the
    selection's attributes, and the four summaries: cells and polygons of
    selections by top percent and by band, with zeros where there is nothing.
    """
    own = settings.source_area
    threshold = float(own.erosion_threshold_m) if own.use_dod_filter else None
    erosion = select.eroded("dz", threshold) if threshold is not None else F.lit(True)
    percents, c_mins, c_max = list(own.top_percent_values), list(own.c_min_values), own.c_channel_max
    table = grid.kept(selection_table(cells, percents, c_mins, c_max, threshold))
    chosen = grid.kept(source_areas(cells, percents, c_mins, c_max, erosion, cell_area, table)[0])
    shapes = grid.kept(source_polygons(chosen, cell_area, settings.least_area()))
    polygons = shapes.join(F.broadcast(table), "label").select("label", "component", "source_id", F.col("source_id").alias("mass__wasting_id"), "top_percent", "pci_cutoff", "c_min", "c_max", "dod_thresh", "method", "area_m2", "area_km2")
    cell_sums = table.join(chosen.groupBy("label").agg(F.count("*").alias("n")), "label", "left").withColumn("source_pixels", F.coalesce("n", F.lit(0)))
    cell_sums = cell_sums.withColumn("source_area_m2", F.col("source_pixels") * float(cell_area)).withColumn("source_area_km2", F.col("source_area_m2") / 1e6)
    areas = shapes.groupBy("label").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area"))
    shape_sums = table.join(areas, "label", "left").withColumn("n_polygons", F.coalesce("n", F.lit(0))).withColumn("polygon_area_m2", F.coalesce("area", F.lit(0.0)))
    shape_sums = shape_sums.withColumn("polygon_area_km2", F.col("polygon_area_m2") / 1e6)
    flags = [F.col("dod_thresh").isNotNull().alias("dod_filter"), F.col("dod_thresh").alias("dod_threshold_m")]
    pixels, shape = ["source_pixels", "source_area_m2", "source_area_km2"], ["n_polygons", "polygon_area_m2", "polygon_area_km2"]
    return {
        "cells": chosen,
        "polygons": polygons,
        "cell_rows": cell_sums.where("top_percent IS NOT NULL").select("top_percent", "pci_cutoff", *pixels, "label"),
        "polygon_rows": shape_sums.where("top_percent IS NOT NULL").select("top_percent", *shape, "label"),
        "c_band_cell_rows": cell_sums.where("c_min IS NOT NULL").select("c_min", "c_max", *flags, *pixels, "label"),
        "c_band_polygon_rows": shape_sums.where("c_min IS NOT NULL").select("c_min", "c_max", *flags, *shape, "label"),
    }


def source_polygons(chosen: DataFrame, cell_area: float, least_area: float = 0.0) -> DataFrame:
    """Components of every selection in one run, with their statistics."""
    parts = grid.components(chosen.select("label", "cid", "r", "c"), ["label"])
    return grid.polygons(parts.join(chosen.select("label", "cid", "pci"), ["label", "cid"]), cell_area, least_area, ["label"], "pci")


def terrain(cells: DataFrame, cell_size: float, alpha: float = 1.167, value: str = "z", fill_sinks: bool = True, directions: int = 8) -> DataFrame:
    """``(cid, r, c, z, filled, a, s, g)``: sinks filled, flow gathered, slope, specific area and driving index.

    Without ``fill_sinks`` water stays in sinks and flats, and ``filled`` is the elevation. ``directions`` 4 leaves out the
    diagonal ones. A cell without a lower neighbour has slope 0.
    """
    offsets = grid.FOUR if directions == 4 else grid.EIGHT
    valid = cells.where(F.col(value).isNotNull())
    full = grid.filled(cells, value) if fill_sinks else valid.select("cid", "r", "c", F.col(value).alias("z"), F.col(value).alias("filled"))
    out = tiles.relief(full, "z", "filled", cell_size, offsets, fill_sinks)
    out = out.select("cid", "r", "c", "z", "filled", (F.col("cells_up") * float(cell_size)).alias("a"), F.col("slope").alias("s"))
    return out.withColumn("g", driving_index("a", "s", alpha))


def scored(cells: DataFrame, settings: Settings, rasters: dict[str, DataFrame] | None = None) -> DataFrame:
    """``cells(cid, r, c, g)`` with ``pci`` and ``c_model_mean``: the three inputs as the settings say, constant, drawn, or a raster.

    A raster input's cells ``(r, c, value)`` are in ``rasters``, or else read from the path of its spec; its values are converted as its
    spec says. A cell without a value there has no ``pci``. Thresholds are rounded to 32-bit floats nowhere but where bands are written.
    Cells are read once: they meet their rasters and go through the scores as whole rows, so they are shuffled for the rasters alone.
    """
    spark, rasters = cells.sparkSession, rasters or {}
    specs = {k: settings.inputs[k] for k in ("d50", "na", "rainfall_excess")}
    is_raster = {k: str(v.get("mode", "constant")).lower() == "raster" for k, v in specs.items()}
    draws, soil = settings.draws, settings.soil
    if draws.n_samples <= 0:
        raise ValueError("the number of samples must be over 0")
    # drawn inputs in SI units, in the units that sample tables have
    si = {k: converted(sampling.drawn(v, draws.seed, k, "id"), k, v) for k, v in specs.items() if not is_raster[k]}
    any_of = lambda k, scale: si[k] * scale if k in si else F.lit(None).cast("double")
    samples = spark.range(draws.n_samples).select(F.col("id").alias("i"), any_of("d50", 1000.0).alias("d50_mm"), any_of("na", 1.0).alias("na"), any_of("rainfall_excess", 3_600_000.0).alias("r_mm_hr"))
    met = cells
    for k, raster in is_raster.items():
        if raster:
            band = rasters[k] if k in rasters else tables.read_band(spark, settings.place(specs[k]["path"]), "value")
            met = met.join(band.select("r", "c", converted("value", k, specs[k]).alias(f"_in_{k}")), ["r", "c"], "left")
    given = {arg: F.col(f"_in_{k}") for arg, k in (("d50", "d50"), ("na", "na"), ("r", "rainfall_excess")) if is_raster[k]}
    met = grid.kept(met) if given else met  # the scores read it again and again
    result = select.pci_monte_carlo(met, grid.kept(samples), soil=soil, also=[c for c in cells.columns if c != "cid"], every=True, **given)
    return result.withColumnRenamed("c_mean", "c_model_mean").select(*cells.columns, "pci", "c_model_mean")


def pci_polygons(cells: DataFrame, threshold: float, cell_area: float, least_area: float = 0.0) -> DataFrame:
    """Components of cells with ``pci`` of ``threshold`` or more, with statistics, ids and ``geometry``, their outline as text in cell units."""
    high = grid.kept(cells.where(F.col("pci") >= float(threshold)).select("cid", "r", "c", "pci"))
    parts = grid.kept(grid.components(high.select("cid", "r", "c")).join(high.select("cid", "pci"), "cid"))
    found = grid.kept(grid.polygons(parts, cell_area, least_area, value="pci"))
    shapes = grid.run_texts(grid.ring_runs(grid.outline_points(parts.join(found.select("component"), "component", "left_semi"))))
    return found.join(shapes, "component")


def pci_job(cells: DataFrame, samples: DataFrame, cell_size: float, threshold: float = 0.7, least_area: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Scored cells of a terrain grid, and the polygons of cells at or over ``threshold``."""
    found = grid.kept(select.pci_by_rank(terrain(cells, cell_size), samples))
    return found, pci_polygons(found, threshold, cell_size * cell_size, least_area)


def run_job(cells: DataFrame, settings: Settings, cell_size: tuple[float, float], rasters: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole job as its settings say: ``cells`` with terrain bands, ``pci`` and ``c_model_mean``, and ``source_polygons``.

    ``cells(cid, r, c, z)`` is the elevation. Cells have to be square.
    """
    dx, dy = map(abs, cell_size)
    if abs(dx - dy) > 1e-8 + 1e-5 * dy:
        raise ValueError(f"cells have to be square, not {dx} x {dy}")
    if not cells.where("z IS NOT NULL").limit(1).count():
        raise ValueError("the elevation has no valid cell")
    relief = terrain(cells, dx, settings.alpha, "z", settings.terrain.fill_sinks, settings.terrain.neighbours())
    found = grid.kept(scored(relief, settings, rasters))
    return {"cells": found, "source_polygons": pci_polygons(found, settings.outputs.pci_threshold, dx * dx, settings.outputs.min_area_m2)}


def write_job(results: dict[str, DataFrame], settings: Settings) -> dict[str, str]:
    """Write a job's bands and polygons to the places that its settings name; gives the path of each output."""
    bands = {"slope": "s", "specific_catchment_area": "a", "topographic_driving_index": "g", "c_model_mean": "c_model_mean", "pci": "pci"}
    tables.write_bands(results["cells"], {settings.output(name): column for name, column in bands.items()})
    results["source_polygons"].write.mode("overwrite").parquet(settings.output("source_polygons"))
    return {name: settings.output(name) for name in [*bands, "source_polygons"]}
