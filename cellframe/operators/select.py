"""Probability scores of cells, and the masks and summaries made of them."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, Soil, at_least, band_label, erosion_label, threshold_c, top_label
from .shared import kept

BINS = 100  # bins of a natural logarithm's unit


def pci_by_rank(cells: DataFrame, samples: DataFrame, g: str = "g", c: str = "c") -> DataFrame:
    """``cells`` with ``pci``: the share of sampled thresholds that are ``<= g``; NULL where g is.

    An as-of join by equal bins of the logarithm: a bin knows how many samples
    lie before it and holds its own, sorted; all bins between the first and the
    last exist. The sample table's size is a parameter of the job, not of the
    grid, so it is broadcast; cells are neither sorted nor shuffled.
    """
    bin_of = lambda x: F.floor(F.ln(x) * BINS).cast("long")
    positive = samples.where(F.col(c) > 0).select(F.col(c).alias("_c"), bin_of(F.col(c)).alias("_bin"))
    own = positive.groupBy("_bin").agg(F.array_agg("_c").alias("_own"))
    ends = positive.agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"), F.count("*").alias("_n"))
    low = samples.agg(F.count_if(F.col(c) <= 0).alias("_under"), F.count(c).alias("_all"))
    spine = ends.select(F.explode(F.sequence("_lo", "_hi")).alias("_bin"))
    bins = spine.join(own, "_bin", "left").select("_bin", F.coalesce(F.when(F.col("_own").isNotNull(), F.size("_own")), F.lit(0)).alias("_size"), "_own")
    before = F.sum("_size").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("_bin", F.coalesce(before, F.lit(0)).alias("_before"), F.coalesce("_own", F.array().cast("array<double>")).alias("_own"))
    out = cells.withColumn("_gbin", F.when(F.col(g) > 0, bin_of(F.col(g)))).crossJoin(F.broadcast(ends.crossJoin(low))).join(F.broadcast(bins), F.col("_gbin") == F.col("_bin"), "left")
    inside = F.coalesce("_before", F.lit(0)) + F.coalesce(F.size(F.filter("_own", lambda x: x <= F.col(g))), F.lit(0))
    count = F.when(F.col("_gbin").isNull() | (F.col("_gbin") < F.col("_lo")), 0).when(F.col("_gbin") > F.col("_hi"), F.col("_n")).otherwise(inside)
    pci = F.when(F.col(g).isNotNull(), (count + F.when(F.col(g) >= 0, F.col("_under")).otherwise(0)) / F.col("_all"))
    return out.withColumn("pci", pci).drop("_gbin", "_lo", "_hi", "_n", "_under", "_all", "_bin", "_before", "_own")


#: For one and for two inputs that are bands: intervals of each band, and places in each at which a mean over draws is computed.
SPLIT, NODES = {1: 64, 2: 16}, {1: 10, 2: 7}
G_BINS = 128
NEAR = 1e-9  # relative room for rounding in bounds
#: Fixed: the sense in which the threshold follows each input.
RISES = {"d": True, "n": True, "q": False}


def pci_monte_carlo(cells: DataFrame, samples: DataFrame, d50: Column | None = None, na: Column | None = None, r: Column | None = None, g: str = "g", soil: Soil = Soil(), also: list[str] | None = None, every: bool = False) -> DataFrame:
    """``(cid, pci, c_mean)``, and between them the columns ``also`` of cells, where inputs may be columns of cells (SI units): the share of draws whose threshold is at most ``g``, and their mean.

    Inputs not given come from the sample table, whose size is a parameter. Without bands a cell finds its rank among the draws'
    thresholds (``pci_by_rank``). With one or two, cells fall into boxes of the bands and of ``g``. The threshold rises with diameter and roughness and falls with
    the rate, so a box's corners say which draws are surely at most ``g``, and which surely over it, for all of its cells; a cell
    computes the others alone, some hundredth of all. Means over draws are smooth in the bands: each interval has their Chebyshev series
    (relative error under 1e-7 for one band, 1e-5 for two). Tables of boxes and series have a size set by ``SPLIT``, ``G_BINS`` and the number of draws, not by the grid, and are broadcast.
    With three bands nothing is drawn. A missing band counts as missing ``pci``; cells without ``g`` are left out,
    or with ``every`` have NULLs. Without bands, cells are read once.
    """
    valid = cells.where(F.col(g).isNotNull())
    bands = {k: v.cast("double") for k, v in {"d": d50, "n": na, "q": r}.items() if v is not None}
    drawn = {k: v for k, v in {"d": F.col("d50_mm") / 1000.0, "n": F.col("na"), "q": F.col("r_mm_hr") / 1000.0 / 3600.0}.items() if k not in bands}
    whole = cells if every and not bands else valid
    met = whole.select("cid", F.col(g).cast("double").alias("_g"), *[v.alias(f"_{k}") for k, v in bands.items()], *([F.struct(*also).alias("_also")] if also else []))
    along = ["_also.*"] if also else []
    if not drawn:
        c = threshold_c("_d", "_n", "_q", soil)
        scores = met.select("cid", *along, (c <= F.col("_g")).cast("double").alias("pci"), c.alias("c_mean"))
        return scores.unionByName(_unscored(cells, g, also)) if every else scores
    draws = samples.select(*[v.alias(k) for k, v in drawn.items()])
    if not bands:
        curve = kept(draws.select(threshold_c("d", "n", "q", soil).alias("c")))
        mean = curve.agg(F.avg("c")).first()[0]
        return pci_by_rank(met, curve, "_g").select("cid", *along, "pci", F.when(F.col("_g").isNotNull(), F.lit(mean).cast("double")).alias("c_mean"))
    scores = _by_boxes(met, draws, list(bands), soil).select("cid", *along, "pci", "c_mean")
    return scores.unionByName(_unscored(cells, g, also)) if every else scores


def _unscored(cells: DataFrame, g: str, also: list[str] | None) -> DataFrame:
    none = F.lit(None).cast("double")
    return cells.where(F.col(g).isNull()).select("cid", *(also or []), none.alias("pci"), none.alias("c_mean"))


def _scaled(name: str, value: Column) -> Column:
    """A band on the scale that it is split on: logarithms of diameters and rates, roughness from 0 on."""
    return at_least(value, 0.0) if name == "n" else F.ln(at_least(value, EPS))


def _unscaled(name: str, value: Column) -> Column:
    return value if name == "n" else F.exp(value)


def _by_boxes(met: DataFrame, draws: DataFrame, names: list[str], soil: Soil) -> DataFrame:
    split, nodes, n_draws = SPLIT[len(names)], NODES[len(names)], draws.count()
    met = met.withColumns({f"t_{k}": _scaled(k, F.col(f"_{k}")) for k in names}).withColumn("t_g", F.when(F.col("_g") > 0, F.ln("_g")))
    ends = met.agg(*[f(f"t_{k}").alias(f"{e}_{k}") for k in [*names, "g"] for e, f in (("lo", F.min), ("hi", F.max))]).first()
    width = {k: max(((ends[f"hi_{k}"] or 0.0) - (ends[f"lo_{k}"] or 0.0)) / (split if k != "g" else G_BINS), 1e-12) for k in [*names, "g"]}
    low = {k: ends[f"lo_{k}"] or 0.0 for k in [*names, "g"]}
    bin_of = lambda k: F.coalesce(F.least(F.floor((F.col(f"t_{k}") - low[k]) / width[k]), F.lit((split if k != "g" else G_BINS) - 1)), F.lit(-1)).cast("int")
    met = met.withColumns({f"b_{k}": bin_of(k) for k in [*names, "g"]})
    box = ["b_g", *[f"b_{k}" for k in names]]
    each = met.groupBy(*box).agg(F.min("_g").alias("g0"), F.max("_g").alias("g1"), *[f(f"_{k}").alias(f"{k}{e}") for k in names for e, f in ((0, F.min), (1, F.max))])
    at = lambda high: threshold_c(*[F.col(k) if k not in names else F.col(f"{k}{int(RISES[k] == high)}") for k in "dnq"], soil)
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corners = kept(each).repartition(tasks, *box).crossJoin(F.broadcast(draws)).withColumn("c0", at(False) * (1 - NEAR)).withColumn("c1", at(True) * (1 + NEAR))  # a box and a draw: both are bounded by parameters
    free = F.struct(*[F.col(k) for k in "dnq" if k not in names])
    boxes = kept(corners.groupBy(*box).agg(F.count_if(F.col("c1") <= F.col("g0")).alias("_sure"), F.collect_list(F.when((F.col("c1") > F.col("g0")) & (F.col("c0") <= F.col("g1")), free)).alias("_open")))
    counted = F.size(F.filter("_open", lambda x: threshold_c(*[x[k] if k not in names else F.col(f"_{k}") for k in "dnq"], soil) <= F.col("_g")))
    out = met.join(F.broadcast(boxes), box).withColumn("pci", (F.col("_sure") + counted) / float(n_draws))
    # means over the draws at the Chebyshev places of each interval, turned into a series
    spark, angles = met.sparkSession, [math.pi * (j + 0.5) / nodes for j in range(nodes)]
    places = itertools.product(range(split), range(nodes))
    rows = [(b, j, low[names[0]] + width[names[0]] * (b + 0.5 + 0.5 * math.cos(angles[j]))) for b, j in places]
    grid = spark.createDataFrame(rows, f"b_{names[0]} int, j_{names[0]} int, v_{names[0]} double")
    for k in names[1:]:
        rows = [(b, j, low[k] + width[k] * (b + 0.5 + 0.5 * math.cos(angles[j]))) for b, j in itertools.product(range(split), range(nodes))]
        grid = grid.crossJoin(spark.createDataFrame(rows, f"b_{k} int, j_{k} int, v_{k} double"))
    c = threshold_c(*[F.col(k) if k not in names else _unscaled(k, F.col(f"v_{k}")) for k in "dnq"], soil)
    keys = [f"b_{k}" for k in names]
    means = grid.repartition(tasks).crossJoin(F.broadcast(draws)).groupBy(*keys, *[f"j_{k}" for k in names]).agg(F.avg(c).alias("f"))
    orders = list(itertools.product(range(nodes), repeat=len(names)))
    weight = lambda order: math.prod(1.0 if m == 0 else 2.0 for m in order) / nodes ** len(names)
    term = lambda order: F.sum(F.col("f") * functools.reduce(lambda a, b: a * b, [F.cos(F.lit(float(m)) * math.pi * (F.col(f"j_{k}") + 0.5) / nodes) for k, m in zip(names, order, strict=True)]))
    series = kept(means.groupBy(*keys).agg(F.array(*[term(o) * weight(o) for o in orders]).alias("_series")))
    angle = {k: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * ((F.col(f"t_{k}") - low[k]) / width[k] - F.col(f"b_{k}")) - 1))) for k in names}
    out = out.join(F.broadcast(series), keys, "left").withColumns({f"a_{k}": a for k, a in angle.items()})
    waves = [functools.reduce(lambda a, b: a * b, [F.cos(float(m) * F.col(f"a_{k}")) for k, m in zip(names, o, strict=True)]) for o in orders]
    mean = functools.reduce(lambda a, b: a + b, [F.get("_series", F.lit(i)) * w for i, w in enumerate(waves)])
    whole = functools.reduce(lambda a, b: a & b, [F.col(f"_{k}").isNotNull() for k in names])
    return out.withColumns({"pci": F.when(whole, F.col("pci")), "c_mean": F.when(whole, mean)})


def count_at_most(sorted_values: str, x: Column) -> Column:
    """How many of an ascending array's values are at most ``x``, by halving; arrays of up to four million values."""
    steps = F.array(*[F.lit(1 << k) for k in range(21, -1, -1)])
    ahead = lambda at, k: (at + k <= F.size(sorted_values)) & (F.get(F.col(sorted_values), at + k - 1) <= x)
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(ahead(at, k), at + k).otherwise(at))


def eroded(dz, threshold: float, inclusive: bool = False) -> Column:
    """Whether a cell lost more than the threshold; false where the change is missing."""
    dz = F.col(dz) if isinstance(dz, str) else dz
    return F.coalesce(dz <= float(threshold) if inclusive else dz < float(threshold), F.lit(False))


def percentile_by_value(rows: DataFrame, value: str, percent: float) -> DataFrame:
    """One row with the exact percentile, linear between ranks, from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.expr(f"percentile({value}, {float(percent) / 100.0}D, n)").alias("cutoff"))


def top_percent_cut(cells: DataFrame, percents: list[float], value: str = "pci") -> DataFrame:
    """``(top_percent, pci_cutoff)``: the cutoff of each percent, from all valid cells."""
    if any(not 0 < p <= 100 for p in percents):
        raise ValueError("percents must be over 0 and at most 100")
    counts = cells.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    cuts = counts.agg(*[F.expr(f"percentile({value}, {1 - p / 100.0}D, n)").alias(f"q{k}") for k, p in enumerate(percents)])
    return cuts.select(F.explode(cut_rows(percents)).alias("x")).select("x.*")


def cut_rows(percents: list[float]) -> Column:
    """The cutoffs ``q0, q1, ..`` as an array of rows; fails where there was no valid cell to cut."""
    cut = lambda k: F.coalesce(F.col(f"q{k}"), F.raise_error(F.lit("no valid cells to select from")).cast("double"))
    return F.array(*[F.struct(F.lit(float(p)).alias("top_percent"), cut(k).alias("pci_cutoff")) for k, p in enumerate(percents)])


def top_percent_summary(cells: DataFrame, percents: list[float], erosion: Column | None, cell_area: float, value: str = "pci") -> DataFrame:
    """``(top_percent, pci_cutoff, source_pixels, source_area_m2, source_area_km2)`` in one pass over the cells.

    Cells are counted by their value, with those that the erosion keeps; cuts
    and sums both follow from these counts. A probability has as many values as
    there are draws, and one.
    """
    if any(not 0 < p <= 100 for p in percents):
        raise ValueError("percents must be over 0 and at most 100")
    keep = erosion if erosion is not None else F.lit(True)
    counts = cells.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.count_if(keep).alias("k"))
    cuts = [F.expr(f"percentile(v, {1 - p / 100.0}D, n)").alias(f"q{k}") for k, p in enumerate(percents)]
    every = counts.agg(*cuts, F.collect_list(F.struct("v", "k")).alias("vs"))
    rows = every.select(F.explode(cut_rows(percents)).alias("x"), "vs").select("x.*", "vs")
    over = F.aggregate("vs", F.lit(0).cast("long"), lambda n, y: n + F.when(y["v"] >= F.col("pci_cutoff"), y["k"]).otherwise(0))
    out = rows.select("top_percent", "pci_cutoff", over.alias("source_pixels")).withColumn("source_area_m2", F.col("source_pixels") * float(cell_area))
    return out.withColumn("source_area_km2", F.col("source_area_m2") / 1e6)


def top_percent_cells(cells: DataFrame, percents: list[float], erosion: Column | None = None, value: str = "pci") -> DataFrame:
    """Cells at or over the cutoff of each percent and eroded, with ``top_percent``, ``pci_cutoff`` and ``label``; ties all stay."""
    cuts = top_percent_cut(cells, percents, value)
    keep = F.col(value) >= F.col("pci_cutoff")
    chosen = cells.crossJoin(F.broadcast(cuts)).where(keep & erosion if erosion is not None else keep)
    return chosen.withColumn("label", top_label("top_percent"))


def c_band_cells(cells: DataFrame, c_mins: list[float], c_max: float | None, erosion: Column | None = None, g: str = "g") -> DataFrame:
    """Cells with ``c_min <= g < c_max`` and eroded, for all bands in one pass."""
    bands = cells.sparkSession.createDataFrame([(float(c), None if c_max is None else float(c_max)) for c in c_mins], "c_min double, c_max double")
    keep = (F.col(g) >= F.col("c_min")) & (F.col("c_max").isNull() | (F.col(g) < F.col("c_max")))
    chosen = cells.join(F.broadcast(bands), keep)
    chosen = chosen.where(erosion) if erosion is not None else chosen
    return chosen.withColumn("label", band_label("c_min", "c_max"))


def summary_of(chosen: DataFrame, keys: list[str], every: DataFrame, cell_area: float) -> DataFrame:
    """Cells and area of each selection; selections without cells have zeros."""
    counts = chosen.groupBy(*keys).agg(F.count("*").alias("source_pixels"))
    out = every.join(counts, keys, "left").withColumn("source_pixels", F.coalesce("source_pixels", F.lit(0)))
    return out.withColumn("source_area_m2", F.col("source_pixels") * float(cell_area)).withColumn("source_area_km2", F.col("source_area_m2") / 1e6)


def scenario_cells(cells: DataFrame, scenarios: DataFrame, g: str = "g") -> DataFrame:
    """Cells with ``g > c_model`` of each scenario; scenarios are a few rows of parameters."""
    return cells.join(F.broadcast(scenarios), F.col(g) > F.col("c_model"))


def first_of_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with equal keys, the one that comes first."""
    names = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), position).alias("row"))
    return first.select(*keys, "row.*")


__all__ = ["band_label", "c_band_cells", "eroded", "erosion_label", "first_of_key", "pci_by_rank", "pci_monte_carlo", "percentile_by_value", "scenario_cells", "summary_of", "top_percent_cells", "top_percent_cut"]
