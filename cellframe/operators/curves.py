"""Distribution curves, zonal statistics, histograms and metrics of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles, running_total
from .shared import kept


def ecdf(rows: DataFrame, group: list[str], value: str, plotting: str = "n") -> DataFrame:
    """``(group, value, n_at, p)``: the share of values up to each distinct one; ``n+1`` gives Weibull's position.

    Values are counted, and counts added up over range partitions, so neither a
    group nor the whole table is put in order in one task. Groups are few.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_at"))
    up = kept(running_total(counts, [*group, value], "n_at", "_upto"))
    whole = up.groupBy(*group).agg(F.max("_upto").alias("_end"), F.min(F.col("_upto") - F.col("n_at")).alias("_base"))
    met = up.join(F.broadcast(whole), group) if group else up.crossJoin(F.broadcast(whole))
    return met.select(*group, value, "n_at", ((F.col("_upto") - F.col("_base")) / (F.col("_end") - F.col("_base") + (1 if plotting == "n+1" else 0))).alias("p"))


def curve_family(curves: dict[str, DataFrame], value: str, plotting: str = "n", least: float | None = None) -> DataFrame:
    """``(label, value, n_at, p)``: cumulative curves of several tables in one job; only values over ``least`` count."""
    out = None
    for label, rows in curves.items():
        one = rows.select(F.lit(label).alias("label"), F.col(value).cast("double").alias(value))
        out = one if out is None else out.unionByName(one)
    return ecdf(out if least is None else out.where(F.col(value) > float(least)), ["label"], value, plotting)


def median_of(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """``(group, median_value)`` of values of any number."""
    return quantiles(rows, value, [0.5], group).select(*(group or []), F.col("cut").alias("median_value"))


def quantile_of(cells: DataFrame, p: Column, samples: DataFrame, value: str, out: str) -> DataFrame:
    """The samples' quantile at each cell's probability, linear between ranks; the sample table is broadcast as one sorted array."""
    table = samples.where(F.col(value).isNotNull()).agg(F.array_sort(F.array_agg(value)).alias("_xs"))
    q = F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6)))
    h = q * (F.size("_xs") - 1)
    k = F.floor(h).cast("int")
    low, high = F.get("_xs", k), F.get("_xs", F.least(k + 1, F.size("_xs") - 1))
    return cells.crossJoin(F.broadcast(table)).withColumn(out, F.when(p.isNotNull(), low + (high - low) * (h - k))).drop("_xs")


def zonal_statistics(cells: DataFrame, zone: str, value: str, cuts: tuple[float, ...] = (0.6, 0.7)) -> DataFrame:
    """Mean, median, percent over each cut, and cells of each zone.

    Equal values are counted first, so that a zone's median is that of its
    different values, of which a probability has as many as there are draws and
    one; for other values use ``median_of``.
    """
    over = [(F.sum(F.when(F.col(value) > c, F.col("_n")).otherwise(0)) / F.sum("_n") * 100).alias("percent_gt_" + str(c).replace(".", "_")) for c in cuts]
    valid = cells.where(F.col(value).isNotNull() & F.col(zone).isNotNull()).groupBy(zone, value).agg(F.count("*").alias("_n"))
    return valid.groupBy(zone).agg((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean_value"), F.expr(f"percentile({value}, 0.5D, _n)").alias("median_value"), *over, F.sum("_n").alias("n_cells"))


def category_distribution(cells: DataFrame, code: str) -> DataFrame:
    counts = cells.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(code, "n", (F.col("n") / F.col("_all")).alias("probability"), (F.col("n") / F.col("_all") * 100).alias("percent"))


def validation(cells: DataFrame, value: str) -> DataFrame:
    return cells.agg(F.count(value).alias("n_valid"), F.min(value).alias("low"), F.avg(value).alias("mean_value"), F.max(value).alias("high"))


def distribution_summary(rows: DataFrame, value: str) -> DataFrame:
    """Smallest, mean, median and largest value; the median by range partitions."""
    rest = rows.agg(F.min(value).alias("low"), F.avg(value).alias("mean_value"), F.max(value).alias("high"))
    return rest.join(F.broadcast(median_of(rows, value)), F.lit(True), "left").select("low", "mean_value", "median_value", "high")


def histogram(rows: DataFrame, value: str, bins: int, group: list[str] | None = None) -> DataFrame:
    """``(group, bin, n, density)`` over ``bins`` equal bins of the whole range; the largest value is in the last one.

    If all values are equal they are in the first bin, whose width counts as 1.
    """
    group = group or []
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*group, k.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("_w"))
    total = F.sum("n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))  # a row for each bin
    return counts.withColumn("density", F.col("n") / (total * F.col("_w"))).drop("_w")


def weibull_fit(rows: DataFrame, value: str, tolerance: float = 1e-10, rounds: int = 60) -> tuple[float, float]:
    """Shape and scale of a Weibull distribution at location 0 by maximum likelihood; one aggregate for each Newton step."""
    x = F.col(value)
    positive = kept(rows.where(x > 0).select(value))
    low, high = positive.agg(F.min(x), F.max(x)).first()
    if low is None:
        raise ValueError("no positive values")
    if low == high:
        raise ValueError("all values are equal, so no shape fits best")
    shape = 1.0
    for _ in range(rounds):
        power = F.pow(x, F.lit(shape))
        n, s0, s1, s2, logs = positive.agg(F.count("*"), F.sum(power), F.sum(power * F.ln(x)), F.sum(power * F.ln(x) * F.ln(x)), F.sum(F.ln(x))).first()
        off = s1 / s0 - 1 / shape - logs / n
        slope = (s2 * s0 - s1 * s1) / s0**2 + 1 / shape**2
        step = off / slope
        shape = shape - step if step < shape else shape / 2
        if abs(step) < tolerance * shape:
            break
    else:
        raise RuntimeError(f"the fit did not settle in {rounds} rounds")
    total, n = positive.agg(F.sum(F.pow(x, F.lit(shape))), F.count("*")).first()
    return shape, math.exp(math.log(total / n) / shape)


def confusion(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """Counts of all four pairs of 0 and 1, zeros among them."""
    spine = rows.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], f"{truth} int, {said} int")
    counts = rows.groupBy(F.col(truth).cast("int").alias(truth), F.col(said).cast("int").alias(said)).agg(F.count("*").alias("n"))
    return spine.join(counts, [truth, said], "left").select(truth, said, F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, their plain and weighted means, and the accuracy; 0 for 0/0."""
    t, s = F.col(truth), F.col(said)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    sums = rows.agg(F.count("*").alias("n"), F.count_if(t == s).alias("hit"), *[f(k).alias(f"{name}{k}") for k in (0, 1) for name, f in (("tp", lambda k: F.count_if((t == k) & (s == k))), ("said", lambda k: F.count_if(s == k)), ("true", lambda k: F.count_if(t == k)))])
    each = sums.select("n", "hit", F.explode(F.array(*[F.struct(F.lit(str(k)).alias("class"), ratio(F.col(f"tp{k}"), F.col(f"said{k}")).alias("precision"), ratio(F.col(f"tp{k}"), F.col(f"true{k}")).alias("recall"), F.col(f"true{k}").alias("support")) for k in (0, 1)])).alias("x")).select("n", "hit", "x.*")
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    macro = each.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted").alias("class"), *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    accuracy = sums.select(F.lit("accuracy").alias("class"), *[ratio(F.col("hit"), F.col("n")).alias(c) for c in names], F.col("n").alias("support"))
    return each.select("class", *names, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def regression_scores(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """R2, RMSE and MSE over rows that have both values, in one pass of sums; R2 is NULL where the truth doesn't vary."""
    valid = rows.where(F.col(truth).isNotNull() & F.col(said).isNotNull())
    d = F.col(truth) - F.col(said)
    return valid.agg((1 - F.try_divide(F.sum(d * d), F.var_pop(truth) * F.count("*"))).alias("r2"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d * d).alias("mse"))


def location_and_scale(rows: DataFrame, features: list[str], center: str = "mean", least: float = 0.0) -> DataFrame:
    """``(feature, location, scale)`` of all features; a scale of zero, or under ``least``, becomes 1.

    Means and deviations come from one pass; medians from the features stacked
    in one table and put in order over range partitions.
    """
    sums = rows.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    scale = lambda f: F.when(F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) > least, F.col(f"s_{f}")).otherwise(F.lit(1.0))
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("location"), scale(f).alias("scale")) for f in features])).alias("x")).select("x.*")
    if center == "mean":
        return out
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    middle = median_of(long, "v", ["feature"])
    return out.drop("location").join(F.broadcast(middle), "feature", "left").select("feature", F.col("median_value").alias("location"), "scale")


def imputed_and_scaled(rows: DataFrame, features: list[str], center: str = "median", least: float = 0.0) -> DataFrame:
    """Missing features become their location, then all are centred and scaled."""
    known = {r.feature: r for r in location_and_scale(rows, features, center, least).collect()}  # a row for each feature
    return rows.withColumns({f: (F.coalesce(F.col(f), F.lit(known[f].location)) - F.lit(known[f].location)) / F.lit(known[f].scale) for f in features})
