"""Ranks, running totals and quantiles of whole tables, by range partitions and prefix sums: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written, with ``_part`` and ``_at``: the number of the range partition, and the place inside it from 0."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    placed = kept(placed)
    return placed.withColumn("_part", F.shiftright("_slot", 33)).withColumn("_at", F.col("_slot").bitwiseAND((1 << 33) - 1)).drop("_slot")


def numbered(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in the order of the columns; only a row of each partition meets in one task."""
    placed = in_ranges(rows, order)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each one in the order of the columns."""
    placed = in_ranges(rows, order)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_inside", inside).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_at", "_base", "_inside")


def quantiles(rows: DataFrame, value: str, shares: list[float], group: list[str] | None = None) -> DataFrame:
    """``(group, share, cut)``: exact quantiles, linear between ranks, of a column's values that aren't missing.

    Values are counted, put in order over range partitions, and numbered by
    running totals; only the values beside each wanted rank are looked up.
    ``group`` is for groups of any size that are few.
    """
    group = group or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    up = kept(running_total(counts, [*group, "_v"], "_n", "_upto"))
    whole = up.groupBy(*group).agg((F.max("_upto") - F.min(F.col("_upto") - F.col("_n"))).alias("_all"), F.min(F.col("_upto") - F.col("_n")).alias("_base"))
    wanted = whole.select(*group, "_base", F.explode(F.array(*map(F.lit, shares))).alias("share"), "_all").withColumn("_h", F.col("share") * (F.col("_all") - 1))
    ranks = wanted.select(*group, "share", "_h", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_k"), "_base")
    reach = (F.col("_base") + F.col("_k") >= F.col("_upto") - F.col("_n")) & (F.col("_base") + F.col("_k") < F.col("_upto"))
    met = up.drop(*group).join(F.broadcast(ranks), reach)  # a few ranks for each group
    ends = met.groupBy(*group, "share").agg(F.first("_h").alias("_h"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return ends.select(*group, "share", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("cut"))
