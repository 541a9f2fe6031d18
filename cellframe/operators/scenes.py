"""Composites, time series and alignment of scenes and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256  # columns of a tile, part of the key that cells and spans meet on
REDUCERS = {"mean": F.avg, "max": F.max, "min": F.min, "median": lambda v: F.expr(f"percentile({v}, 0.5D)")}


def in_window(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """Scenes from ``start`` up to, but not at, ``end``; the predicate reaches the scan."""
    return scenes.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def in_area(scenes: DataFrame, area: DataFrame, key: str = "cid") -> DataFrame:
    """Scenes of the cells of an area."""
    return scenes.join(area.select(key).distinct(), key, "left_semi")


def composite(scenes: DataFrame, start: str, end: str, reducer: str, keys: tuple[str, ...] = ("cid",), on_empty: str = "keep") -> DataFrame:
    """Each cell's reduced value over a window, and the number of its images. ``on_empty="error"`` looks, and fails if the window has no image."""
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer {reducer}")
    valid = in_window(scenes, start, end).where("value IS NOT NULL")
    if on_empty == "error" and not valid.limit(1).count():
        raise ValueError(f"no images from {start} to {end}")
    return valid.groupBy(*keys).agg(REDUCERS[reducer]("value").alias("value"), F.count_distinct("ts").alias("n_images"))


def time_series(scenes: DataFrame, keys: tuple[str, ...] = ("product", "date")) -> DataFrame:
    valid = scenes.where("value IS NOT NULL")
    return valid.groupBy(*keys).agg(F.avg("value").alias("mean_value"), F.expr("percentile(value, 0.5D)").alias("median_value"), F.stddev_pop("value").alias("std_value"), F.count("*").alias("n"))


def monthly_median(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """Median of each cell and month whose first day is inside the window; months without images are absent."""
    months = scenes.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc("month", F.lit(start).cast("date")).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month")).where((F.col("month") >= F.lit(start).cast("date")) & (F.col("month") <= F.lit(end).cast("date")))
    each = scenes.where("value IS NOT NULL").withColumn("month", F.date_trunc("month", "ts").cast("date"))
    return each.join(F.broadcast(months), "month").groupBy("month", "cid").agg(F.expr("percentile(value, 0.5D)").alias("value"))


def closest(scenes: DataFrame, date: str, days: int, keys: tuple[str, ...] = ("cid",)) -> DataFrame:
    """Each key's scene nearest to a time, within days of it; of equally near ones the earlier."""
    at = F.lit(date).cast("timestamp_ntz")
    off = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    near = scenes.withColumn("_off", off).where(F.col("_off") <= days * 86400 * 1000000)
    return near.groupBy(*keys).agg(F.min_by(F.struct("ts", "value"), F.struct("_off", "ts", "value")).alias("x")).select(*keys, "x.ts", "x.value")


def mosaic(scenes: DataFrame, keys: tuple[str, ...] = ("cid",)) -> DataFrame:
    """The last value that isn't missing."""
    return scenes.where("value IS NOT NULL").groupBy(*keys).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def change(after: DataFrame, before: DataFrame, key: str = "cid") -> DataFrame:
    """After less before, where both have a value."""
    return after.select(key, F.col("value").alias("post")).join(before.select(key, F.col("value").alias("pre")), key).select(key, (F.col("post") - F.col("pre")).alias("value"))


def aligned(left: DataFrame, right: DataFrame, grids: DataFrame, keys: tuple[str, ...] = ("grid_id", "r", "c")) -> DataFrame:
    """Two bands of one grid by cell; raises if their headers differ."""
    if grids.drop("band").distinct().groupBy("grid_id").count().where("count > 1").limit(1).count():
        raise ValueError("the bands' grids differ")
    return left.join(right, list(keys))


def same_template(cells: DataFrame, template: DataFrame, value: str) -> DataFrame:
    """Cells whose template cell is valid."""
    return cells.join(template.where(F.col(value).isNotNull()).select("cid"), "cid", "left_semi")


def resampled(cells: DataFrame, value: str, factor: float, height: int, width: int, method: str = "nearest") -> DataFrame:
    """``(r, c, value)`` on a grid of ``height`` x ``width`` whose cells are ``factor`` source cells wide, at the same origin.

    ``nearest`` takes the source cell below the centre; ``bilinear`` weighs the
    four around it by nearness, over those that are valid; ``average`` weighs
    source cells by their overlap. Each is an equi-join on source cells.
    """
    source = cells.where(F.col(value).isNotNull()).select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(value).alias("v"))
    target = cells.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c"))
    f = float(factor)
    if method == "nearest":
        at = lambda x: F.floor((F.col(x) + 0.5) * f)
        return target.withColumn("sr", at("r")).withColumn("sc", at("c")).join(source, ["sr", "sc"], "left").select("r", "c", F.col("v").alias("value"))

    def parts(x: str, out: str) -> Column:
        if method == "bilinear":
            mid = (F.col(x) + 0.5) * f - 0.5
            low = F.floor(mid)
            return F.array(F.struct(low.alias(out), (1 - (mid - low)).alias("w")), F.struct((low + 1).alias(out), (mid - low).alias("w")))
        lo, hi = F.col(x) * f, (F.col(x) + 1) * f
        return F.transform(F.sequence(F.floor(lo), F.ceil(hi) - 1), lambda k: F.struct(k.alias(out), (F.least(hi, k + 1.0) - F.greatest(lo, k.cast("double"))).alias("w")))

    each = target.select("r", "c", F.explode(parts("r", "sr")).alias("a"), F.col("c").alias("c2")).select("r", "c", "a.sr", F.col("a.w").alias("wr"), F.explode(parts("c", "sc")).alias("b")).select("r", "c", "sr", "b.sc", (F.col("wr") * F.col("b.w")).alias("w"))
    got = each.where("w > 0").join(source, ["sr", "sc"], "left").groupBy("r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("t"))
    return got.select("r", "c", F.try_divide("s", "t").alias("value"))


def in_polygons(height: int, polygons: DataFrame, cells: DataFrame) -> DataFrame:
    """``(poly_id, cid)``: cells whose centre lies in a polygon, holes left out, by scan lines.

    ``polygons(poly_id, rings array<array<struct<x,y>>>)`` are in cell units, x
    along columns and y along rows. An edge crosses the rows whose centre is in
    its half-open span; a row's crossings, sorted, pair into spans of cells.
    """
    rings = polygons.select("poly_id", F.explode("rings").alias("ring"))
    turn = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    edges = rings.select("poly_id", F.explode(turn).alias("e")).select("poly_id", "e.*").where("y0 <> y1")
    low, high = F.ceil(F.least("y0", "y1") - 0.5), F.ceil(F.greatest("y0", "y1") - 0.5) - 1
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(height - 1))
    hits = edges.where(low <= high).select("poly_id", F.explode(F.sequence(low, high)).alias("r"), (F.lit(0.5)).alias("half"), "x0", "y0", "x1", "y1")
    hits = hits.withColumn("x", F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    row = Window.partitionBy("poly_id", "r").orderBy("x")
    spans = hits.withColumn("k", F.row_number().over(row)).withColumn("to", F.lead("x").over(row)).where("k % 2 = 1")
    spans = spans.select("poly_id", "r", F.ceil(F.col("x") - 0.5).alias("lo"), (F.ceil(F.col("to") - 0.5) - 1).alias("hi")).where("lo <= hi")
    tiles = F.sequence(F.floor(F.col("lo") / TILE), F.floor(F.col("hi") / TILE))
    spans = spans.withColumn("tile", F.explode(tiles))
    return cells.select("cid", "r", "c", F.floor(F.col("c") / TILE).alias("tile")).join(spans, ["r", "tile"]).where("c BETWEEN lo AND hi").select("poly_id", "cid").distinct()


def in_zones(membership: DataFrame, ids: list) -> DataFrame:
    """Cells of the polygons whose ids are listed, each cell once: training or test zones of ``in_polygons``."""
    return membership.where(F.col("poly_id").isin(ids)).select("cid").distinct()


def polygon_pixels(membership: DataFrame, cells: DataFrame, value: str, cell_area: float) -> DataFrame:
    """``(poly_id, pixel_count, area_m2, area_km2)``: valid cells of each polygon."""
    valid = cells.where(F.col(value).isNotNull()).select("cid")
    counts = membership.join(valid, "cid").groupBy("poly_id").agg(F.count("*").alias("pixel_count"))
    area = F.col("pixel_count") * float(cell_area)
    return counts.select("poly_id", "pixel_count", area.alias("area_m2"), (area / 1e6).alias("area_km2"))


def clipped_to(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells, or a layer's cells, that lie in an area's cells."""
    return cells.join(area.select("cid").distinct(), "cid", "left_semi")


def dissolved(*layers: DataFrame) -> DataFrame:
    """The cells that any of the layers holds, each once."""
    out = layers[0].select("cid", "r", "c")
    for layer in layers[1:]:
        out = out.unionByName(layer.select("cid", "r", "c"))
    return out.distinct()


def classes_of(rows: DataFrame, column: str) -> DataFrame:
    """The different classes of a column, missing ones left out."""
    return rows.select(column).dropna().distinct()


def largest(polygons: DataFrame, k: int = 4, by: str = "area_m2", key: str = "component") -> DataFrame:
    """The ``k`` largest polygons; of equal ones those that come first. A report of a few rows."""
    return polygons.orderBy(F.desc(by), key).limit(k)
