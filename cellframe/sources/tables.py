"""Bands, masks, layers, samples and summaries as Parquet and CSV datasets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite, nodata_to_null
from ..operators.shared import forget, kept

NODATA = -9999.0
TILE = 64
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def write_band(cells: DataFrame, path: str, value: str, nodata: float = NODATA, tile: int = TILE) -> None:
    """A band as tiles ``(tr, tc, at, band)`` of 32-bit floats; values that aren't finite become ``nodata``.

    A tile holds ``tile * tile`` cells at most, whatever the grid's size.
    """
    _tiled(cells, [value], nodata, tile).select("tr", "tc", "at", F.col("b0").alias("band")).write.mode("overwrite").parquet(path)


def write_bands(cells: DataFrame, bands: dict[str, str], nodata: float = NODATA, tile: int = TILE) -> None:
    """Bands of the same cells, a column for each path, as ``write_band`` writes them; cells go to their tiles once for all of them."""
    tiles = kept(_tiled(cells, list(bands.values()), nodata, tile))
    for k, path in enumerate(bands):
        tiles.select("tr", "tc", "at", F.col(f"b{k}").alias("band")).write.mode("overwrite").parquet(path)
    forget(tiles)


def _tiled(cells: DataFrame, values: list[str], nodata: float, tile: int) -> DataFrame:
    """``(tr, tc, at, b0, b1, ..)``: tiles of several columns."""
    bands = [F.coalesce(finite(v), F.lit(float(nodata))).cast("float").alias(f"b{k}") for k, v in enumerate(values)]
    at = (F.pmod("r", F.lit(tile)) * tile + F.pmod("c", F.lit(tile))).cast("int")
    each = cells.select(F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"), F.struct(at.alias("at"), *bands).alias("x"))
    tiles = each.groupBy("tr", "tc").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return tiles.select("tr", "tc", F.col("x.at").alias("at"), *[F.col(f"x.b{k}").alias(f"b{k}") for k in range(len(values))])


def read_band(spark: SparkSession, path: str, value: str, nodata: float = NODATA, tile: int = TILE) -> DataFrame:
    """``(r, c, value)`` of a band's cells, nodata as NULL."""
    tiles = spark.read.parquet(path).select("tr", "tc", F.explode(F.arrays_zip("at", "band")).alias("x"))
    r, c = F.col("tr") * tile + F.floor(F.col("x.at") / tile), F.col("tc") * tile + F.col("x.at") % tile
    return tiles.select(r.alias("r"), c.alias("c"), nodata_to_null(F.col("x.band"), nodata).alias(value))


def read_bands(spark: SparkSession, paths: dict[str, str], nodata: float = NODATA, tile: int = TILE) -> DataFrame:
    """``(r, c, values)`` of the cells that all of the bands have, a path for each value, nodata as NULL. Bands meet as tiles, before they are cells."""
    parts = [spark.read.parquet(p).select("tr", "tc", F.col("at").alias(f"at{k}"), F.col("band").alias(f"b{k}")) for k, p in enumerate(paths.values())]
    met, n_bands = parts[0], len(parts)
    for part in parts[1:]:
        met = met.join(part, ["tr", "tc"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda n: batch.column(n)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                at, bands = row("at0"), [row("b0")]
                for k in range(1, n_bands):  # places are in order
                    other = row(f"at{k}")
                    first, n = np.searchsorted(other, at), np.searchsorted(other, at, "right") - np.searchsorted(other, at)
                    mine = np.repeat(np.arange(len(at)), n)
                    its = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    at, bands = at[mine], [*(b[mine] for b in bands), row(f"b{k}")[its]]
                r, c = np.divmod(at.astype(np.int64), tile)
                columns = [r + batch.column("tr")[i].as_py() * tile, c + batch.column("tc")[i].as_py() * tile, *bands]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["r", "c", *(f"b{k}" for k in range(n_bands))])

    rows = met.mapInArrow(run, "r long, c long, " + ", ".join(f"b{k} float" for k in range(n_bands)))
    return rows.select("r", "c", *[nodata_to_null(F.col(f"b{k}"), nodata).alias(v) for k, v in enumerate(paths)])


def write_mask(cells: DataFrame, path: str, mask: str, on: int = 1) -> None:
    """A mask as bytes or small integers, 0 or ``on``; NULL where it has no value."""
    v = F.when(F.col(mask).isNotNull(), F.when(F.col(mask).cast("boolean"), on).otherwise(0)).cast("short")
    cells.select("r", "c", v.alias(mask)).write.mode("overwrite").parquet(path)


def all_bands_valid(cells: DataFrame, bands: str) -> DataFrame:
    """Cells of a multiband table whose bands are all present and finite."""
    return cells.where(F.forall(bands, lambda x: finite(x).isNotNull()))


def write_sorted(rows: DataFrame, path: str, by: list[str], columns: list[str] | None = None) -> None:
    """Rows of a time series, coefficients, importances or predictions as CSV, in order over the files."""
    rows.orderBy(*by).select(*(columns or rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_layer(polygons: DataFrame, path: str) -> None:
    """A polygon layer; one that is there already is replaced."""
    polygons.write.mode("overwrite").parquet(path)


def read_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Layers one after another, columns matched by name, with ``source_file``."""
    layers = [spark.read.parquet(p).select("*", F.col("_metadata.file_path").alias("source_file")) for p in paths]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


RINGS = "array<array<struct<x:double,y:double>>>"


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """A polygon layer: its properties as columns, and ``rings``.

    ``properties`` is their schema. A file is one collection of features, or with
    ``lines`` a feature on each line, which Spark can split. A polygon's rings
    are its outline and its holes; those of several polygons follow one another,
    as even-odd membership needs them. Features without a polygon have no rings.
    """
    shape = "array<array<array<double>>>"
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    if lines:
        each = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", feature).alias("f"))
    else:
        whole = spark.read.text(path, wholetext=True)
        each = whole.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    flat = F.when(kind == "Polygon", F.from_json(text, shape)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{shape}>")))
    rings = F.transform(F.coalesce(flat, F.array().cast(shape)), lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return each.select("f.properties.*", rings.alias("rings"))


def write_geojson(polygons: DataFrame, path: str) -> None:
    """A layer as lines of GeoJSON features; all columns but ``rings`` are properties. One that is there is replaced."""
    names = [c for c in polygons.columns if c != "rings"]
    points = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")).alias("geometry"))
    polygons.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """A CSV dataset with a header; ``one_file`` is for summaries of a few rows."""
    rows = rows.select(*(columns or rows.columns))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def read_samples(spark: SparkSession, path: str, value: str = "C") -> DataFrame:
    """Samples from CSV; missing, infinite and non-positive values are dropped."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in rows.columns])
    return rows.where(finite(value) > 0)


def reused(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The dataset at ``path``, built and written first where there is none, or none that was finished."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in MISSING:
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
