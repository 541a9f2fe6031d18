"""Reproducible draws: the same seed gives the same table, however rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .expr import Soil, threshold_c


def uniform(seed: int, name: str, key) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed, name and key."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:{name}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def uniform_between(low: float, high: float, seed: int, name: str, key="i") -> Column:
    return float(low) + (float(high) - float(low)) * uniform(seed, name, key)


def normal(seed: int, name: str, key="i") -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    u, v = 1 - uniform(seed, name + ".u", key), uniform(seed, name + ".v", key)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def lognormal(mean: float, std: float, seed: int, name: str, key="i") -> Column:
    """Lognormal with this arithmetic mean and standard deviation."""
    if mean <= 0 or std <= 0:
        raise ValueError("mean and std must be over 0")
    var = math.log(1 + (std / mean) ** 2)
    return F.exp(math.log(mean) - var / 2 + math.sqrt(var) * normal(seed, name, key))


def lognormal_of_logs(mu: float, sigma: float, seed: int, name: str, key="i") -> Column:
    return F.exp(float(mu) + float(sigma) * normal(seed, name, key))


def drawn(spec: dict, seed: int, name: str, key="i") -> Column:
    """A draw, or a constant, as a spec says it: in the spec's own units."""
    mode = spec.get("mode", "distribution" if "distribution" in spec else "constant")
    pick = lambda stem: next((float(spec[k]) for k in spec if k == stem or k.startswith(f"{stem}_")), None)
    if mode == "constant":
        if (value := pick("value")) is None:
            raise ValueError(f"{name} needs a value")
        return F.lit(value)
    if mode != "distribution":
        raise ValueError(f"{name}: a sampled input is a constant or a distribution, not {mode}")
    if spec["distribution"] == "uniform":
        low, high = pick("min"), pick("max")
        if low is None or high is None:
            raise ValueError(f"{name} needs min and max")
        return uniform_between(low, high, seed, name, key)
    if spec["distribution"] == "lognormal":
        return lognormal(pick("mean") or 0.0, pick("std") or 0.0, seed, name, key)
    raise ValueError(f"{name}: unknown distribution {spec['distribution']}")


#: Default draws of the three inputs, in mm, without unit, and in mm/hr.
DEFAULT = {
    "d50": {"mode": "distribution", "distribution": "lognormal", "mean_mm": 2.0, "std_mm": 0.48},
    "na": {"mode": "distribution", "distribution": "uniform", "min": 0.015, "max": 0.10},
    "r": {"mode": "distribution", "distribution": "uniform", "min_mm_hr": 15.0, "max_mm_hr": 55.0},
}


def c_samples(spark: SparkSession, n: int = 1500, seed: int = 42, specs: dict | None = None, soil: Soil = Soil()) -> DataFrame:
    """``(i, d50_mm, na, r_mm_hr, c)``: n draws and the threshold of each."""
    if n <= 0:
        raise ValueError("the number of samples must be over 0")
    specs = DEFAULT | (specs or {})
    draws = spark.range(n).select(F.col("id").alias("i"), drawn(specs["d50"], seed, "d50", "id").alias("d50_mm"), drawn(specs["na"], seed, "na", "id").alias("na"), drawn(specs["r"], seed, "r", "id").alias("r_mm_hr"))
    return draws.withColumn("c", threshold_c(F.col("d50_mm") / 1000.0, "na", F.col("r_mm_hr") / 1000.0 / 3600.0, soil))


def curve_samples(spark: SparkSession, curves: list[tuple[str, float, float, float, float, float]], n: int, seed: int) -> DataFrame:
    """Draws for many curves ``(label, d50_mm, na_lo, na_hi, r_lo, r_hi)`` in one job."""
    table = spark.createDataFrame(curves, "label string, d50_mm double, na_lo double, na_hi double, r_lo double, r_hi double")
    key = F.concat_ws(":", "label", F.col("id").cast("string"))
    na = F.col("na_lo") + (F.col("na_hi") - F.col("na_lo")) * uniform(seed, "na", key)
    r = F.col("r_lo") + (F.col("r_hi") - F.col("r_lo")) * uniform(seed, "r", key)
    draws = spark.range(n).join(F.broadcast(table)).select("label", F.col("id").alias("i"), "d50_mm", na.alias("na"), r.alias("r_mm_hr"))
    return draws.withColumn("c", threshold_c(F.col("d50_mm") / 1000.0, "na", F.col("r_mm_hr") / 1000.0 / 3600.0))


BUCKETS = 1 << 16


def among_lowest(rows: DataFrame, u: Column, key: str, wanted: Column, group: list[str] | None = None, totals: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_low``: whether a row is among the ``wanted`` lowest ``u`` of its group; exact, ties by ``key``.

    ``u`` is uniform in [0, 1). Rows are counted in 65,536 equal buckets; prefix
    sums of these counts settle all buckets but one of each group, and only
    that bucket's rows are put in order. ``wanted`` may use ``_all``, the
    group's size, and the columns of the one row ``totals``. Groups are few.
    """
    group = group or []
    rows = rows.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * BUCKETS))
    counts = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # 65,536 rows of a group at most
    cuts = counts.withColumn("_upto", F.sum("_n").over(part.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(part))
    if totals is not None:
        cuts = cuts.crossJoin(F.broadcast(totals))
    cuts = cuts.select(*group, "_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", wanted.alias("_want"))
    met = rows.join(F.broadcast(cuts), [*group, "_bucket"])
    split = (F.col("_before") < F.col("_want")) & (F.col("_want") < F.col("_upto"))
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_u", key))
    sure = met.where(~split).withColumn("_low", F.col("_upto") <= F.col("_want"))
    edge = met.where(split).withColumn("_low", F.col("_before") + place <= F.col("_want"))
    return sure.unionByName(edge).drop("_u", "_bucket", "_before", "_upto", "_want")


def down_sampled(rows: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """All positives and ``ratio`` times as many negatives, those with the smallest hashes: exact, without replacement."""
    positives = rows.where(F.col(label) == 1)
    negatives = among_lowest(rows.where(F.col(label) == 0), uniform(seed, "negative", key), key, F.round(F.col("_wanted") * float(ratio)), totals=positives.agg(F.count("*").alias("_wanted")))
    return positives.unionByName(negatives.where("_low").select(*rows.columns))


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """``rows`` with ``is_train``: of each class the rounded ``share`` of its rows, those with the smallest hashes."""
    return among_lowest(rows, uniform(seed, "split", key), key, F.round(F.col("_all") * float(share)), [label]).withColumnRenamed("_low", "is_train")


def random_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return rows.withColumn("is_train", uniform(seed, "cells", key) < float(share))


def block_split(cells: DataFrame, value: str, block: int = 256, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Blocks with any valid cell, and whether each is for training: at least one is, and one isn't. Fails where there is but one block."""
    blocks = cells.where(F.col(value).isNotNull()).groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(F.count("*").alias("n_cells"))
    blocks = blocks.withColumn("_key", F.concat_ws(":", "br", "bc"))
    wanted = F.greatest(F.lit(1), F.least(F.col("_all") - 1, F.round(F.col("_all") * share).cast("long")))
    wanted = F.when(F.col("_all") < 2, F.raise_error(F.lit("a split needs two valid blocks at least")).cast("long")).otherwise(wanted)
    return among_lowest(blocks, uniform(seed, "block", "_key"), "_key", wanted).select("br", "bc", "n_cells", F.col("_low").alias("is_train"))


def in_patches(cells: DataFrame, height: int, width: int, patch: int, stride: int, block: int | None = None) -> DataFrame:
    """``cells`` with ``r0, c0``, once for each patch that a cell lies in: patches start every ``stride`` cells and at the far edge.

    With ``block`` patches lie inside blocks of that many cells, and the far edge
    is the block's. A grid or block that is smaller than a patch has none. Each
    cell computes the few patches that it lies in from its own place.
    """

    def of(x: str, size: int) -> Column:
        step = block or size
        low = F.floor(F.col(x) / step) * step
        last = F.least(F.lit(step), F.lit(size) - low) - patch  # the last start, from the block's own
        at = F.col(x) - low
        first = F.greatest(F.lit(0), F.ceil((at - patch + 1) / F.lit(stride)))
        until = F.least(F.floor(at / F.lit(stride)), F.floor(last / F.lit(stride)))
        usual = F.when(first <= until, F.transform(F.sequence(first, until), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
        every = F.when(at >= last, F.array_union(usual, F.array(last.cast("bigint")))).otherwise(usual)
        return F.when(last >= 0, F.transform(every, lambda k: k + low))

    return cells.withColumn("r0", F.explode(of("r", height))).withColumn("c0", F.explode(of("c", width)))


def patch_origins(cells: DataFrame, value: str, height: int, width: int, patch: int, stride: int, least_valid: float = 0.5, block: int | None = None) -> DataFrame:
    """``(r0, c0, valid)``: the patches of ``in_patches`` of which enough cells are valid."""
    each = in_patches(cells.select("r", "c", value), height, width, patch, stride, block)
    share = F.count(value) / F.lit(float(patch * patch))
    return each.groupBy("r0", "c0").agg(share.alias("valid")).where(F.col("valid") >= least_valid)


def patch_arrays(cells: DataFrame, bands: list[str], target: str, height: int, width: int, patch: int, stride: int, least_valid: float = 0.5, block: int | None = None) -> DataFrame:
    """``(r0, c0, x, mask, y)``: each patch as arrays of ``patch * patch`` numbers, row by row: ``x`` one for each band, ``mask`` and ``y``.

    A cell is valid, and ``mask`` 1, if all bands and the target are there; elsewhere all are 0. Patches with a smaller share of
    valid cells than ``least_valid`` are left out. A row has ``patch`` squared cells, whatever the grid's size.
    """
    at = ((F.col("r") - F.col("r0")) * patch + F.col("c") - F.col("c0")).cast("int")
    valid = cells.where(" AND ".join(f"{b} IS NOT NULL" for b in [*bands, target])).select("r", "c", *[F.col(b).cast("double").alias(b) for b in [*bands, target]])
    each = in_patches(valid, height, width, patch, stride, block).groupBy("r0", "c0").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), *bands, target))).alias("v"), F.count("*").alias("n"))
    # zeros between the valid cells in order: each cell brings those before it, so an array is written once
    before = F.zip_with("v", F.concat(F.array(F.lit(-1)), F.slice(F.col("v.at"), 1, F.size("v") - 1)), lambda v, last: v["at"] - last - 1)
    after = F.lit(patch * patch - 1) - F.element_at("v", -1)["at"]
    filled = lambda values, zero: F.concat(F.flatten(F.zip_with(values, "gaps", lambda v, k: F.concat(F.array_repeat(zero, k), F.array(v)))), F.array_repeat(zero, "left_"))
    of = lambda name: filled(F.col(f"v.{name}"), F.lit(0.0))
    mask = filled(F.transform("v", lambda v: F.lit(1)), F.lit(0))
    dense = each.where(F.col("n") >= least_valid * patch * patch).withColumns({"gaps": before, "left_": after})
    return dense.select("r0", "c0", F.array(*map(of, bands)).alias("x"), mask.alias("mask"), of(target).alias("y"))


def patches_averaged(predictions: DataFrame, patch: int, value: str = "p") -> DataFrame:
    """``(r, c, value, n)``: the mean of what overlapping patches ``(r0, c0, mask, value array)`` say of each valid cell, and their number."""
    each = predictions.select("r0", "c0", "mask", F.posexplode(value).alias("k", "v"))
    cells = each.where(F.get("mask", F.col("k")) == 1).select((F.col("r0") + F.floor(F.col("k") / patch)).alias("r"), (F.col("c0") + F.col("k") % patch).alias("c"), "v")
    return cells.groupBy("r", "c").agg(F.avg("v").alias(value), F.count("*").alias("n"))


def balanced_centres(cells: DataFrame, label: str, n: int, half: int, height: int, width: int, seed: int) -> DataFrame:
    """``(i, label, r, c)``: ``n`` patch centres, half of each class, with replacement, none within half a patch of the edge.

    Candidates of a class are numbered by range partitions and prefix sums; each
    draw takes the one whose number is its uniform times the class's size, so
    all candidates are equally likely. Fails where a class has no candidate.
    """
    from ..operators.ranks import numbered

    inside = cells.where((F.col("r") >= half) & (F.col("r") < height - half) & (F.col("c") >= half) & (F.col("c") < width - half) & F.col(label).isin(0, 1))
    ranked = numbered(inside.select(label, "r", "c"), [label, "r", "c"])
    ends = ranked.groupBy(F.col(label).alias("_want")).agg(F.min("rank").alias("_first"), F.count("*").alias("_size"))
    draws = cells.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("_want"), uniform(seed, "centre", "id").alias("_u"))
    met = draws.join(F.broadcast(ends), "_want", "left")
    at = F.when(F.col("_size") > 0, F.col("_first") + F.floor(F.col("_u") * F.col("_size"))).otherwise(F.raise_error(F.lit("a class has no candidate")).cast("long"))
    return met.select("i", at.alias("rank")).join(ranked, "rank").select("i", label, "r", "c")
