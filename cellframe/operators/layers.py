"""Layers of polygons in degrees: one zone for the whole layer, edges projected as rows, areas in square metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import utm_forward
from .shared import kept


def extent(layer: DataFrame, rings: str = "rings") -> tuple[float, float, float, float] | None:
    """``(west, south, east, north)`` of all rings' corners, from one aggregate; None of a layer without any."""
    corners = lambda name, pick: pick(F.transform(F.flatten(rings), lambda p: p[name]))
    row = layer.agg(F.min(corners("x", F.array_min)), F.min(corners("y", F.array_min)), F.max(corners("x", F.array_max)), F.max(corners("y", F.array_max))).first()
    return None if row[0] is None else tuple(row)


def zone_of(layer: DataFrame, rings: str = "rings") -> int | None:
    """The zone, 1 to 60, of the middle of the layer's extent: all polygons of a layer are measured in one."""
    found = extent(layer, rings)
    return None if found is None else min(60, max(1, int(((found[0] + found[2]) / 2 + 180) // 6) + 1))


def edges(polygons: DataFrame, pieces: int) -> DataFrame:
    """``(uid, ring, lon0, lat0, lon1, lat1, home_lon, home_lat)``: the edges of ``polygons(uid, rings)``, each in ``pieces`` equal parts, a row each.

    A closing corner that repeats the first one makes an edge without length; ``home`` is the ring's first corner.
    """
    rings = polygons.select("uid", F.posexplode("rings").alias("ring", "at")).where(F.size("at") > 0)
    after = F.concat(F.slice("at", 2, F.size("at")), F.slice("at", 1, 1))
    sides = rings.select("uid", "ring", F.get("at", F.lit(0)).alias("home"), F.explode(F.arrays_zip(F.col("at").alias("a"), after.alias("b"))).alias("s")).select("uid", "ring", "home", "s.a", "s.b")
    each = sides.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    part = lambda c, k: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * (k / float(pieces))
    points = [part(c, F.col("k") + step).alias(f"{name}{step}") for step in (0, 1) for c, name in (("x", "lon"), ("y", "lat"))]
    return each.select("uid", "ring", *points, F.col("home.x").alias("home_lon"), F.col("home.y").alias("home_lat"))


def geographic_areas(layer: DataFrame, rings: str = "rings", pieces: int = 8, zone: int | None = None) -> DataFrame:
    """``layer`` with ``zone`` and ``area_m2``: each polygon's first ring less its holes, in the zone of the whole layer.

    Edges are straight in degrees, so each is projected in ``pieces`` parts. Edges are rows, projected by column expressions, and their turns are summed before
    they are shuffled; corners are taken from the ring's first one, so that large coordinates cost no digits. A polygon without rings, or with null ones, has the
    area 0; an empty layer gives an empty result.
    """
    zone = zone_of(layer, rings) if zone is None else zone
    named = kept(layer.withColumn("_uid", F.monotonically_increasing_id()))
    if zone is None:
        return named.drop("_uid").withColumn("zone", F.lit(None).cast("int")).withColumn("area_m2", F.lit(0.0))
    metres = lambda lon, lat: utm_forward(lon, lat, F.lit(zone))[1:]
    flat = edges(named.select(F.col("_uid").alias("uid"), F.col(rings).alias("rings")), pieces)
    for name in ("0", "1", "home"):
        lon, lat = ("home_lon", "home_lat") if name == "home" else (f"lon{name}", f"lat{name}")
        x, y = metres(lon, lat)
        flat = flat.withColumns({f"x_{name}": x, f"y_{name}": y})
    off = lambda c, k: F.col(f"{c}_{k}") - F.col(f"{c}_home")
    turn = off("x", 0) * off("y", 1) - off("x", 1) * off("y", 0)
    each = flat.groupBy("uid", "ring").agg((F.abs(F.sum(turn)) / 2).alias("area"))
    areas = each.groupBy(F.col("uid").alias("_uid")).agg(F.sum(F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area_m2"))
    return named.join(areas, "_uid", "left").drop("_uid").withColumn("zone", F.lit(zone)).withColumn("area_m2", F.coalesce("area_m2", F.lit(0.0)))
