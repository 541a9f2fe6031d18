"""Cells, zones, scenes and bands derived from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell for each order: place, elevation, change of elevation, area, slope, index, soil."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), (F.avg("l_discount") * 10.0).alias("s"))
    cell = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    r, c, price = F.floor(F.col("o_orderkey") / WIDTH), F.col("o_orderkey") % WIDTH, F.col("o_totalprice") / 5e5
    z = 1000.0 - 2.0 * r - 0.2 * c + 3.0 * price
    return cell.select(F.col("o_orderkey").alias("cid"), r.alias("r"), c.alias("c"), z.alias("z"), (price - 0.5).alias("dz"), "a", "s", (F.col("a") * F.pow("s", F.lit(1.167))).alias("g"), F.col("o_orderpriority").alias("soil"), F.col("o_custkey").alias("custkey"))


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid, from the largest key alone."""
    return int(table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]) // WIDTH + 1


CELLS = """cells AS (
    SELECT o_orderkey AS cid, o_orderkey // 100 AS r, o_orderkey % 100 AS c,
           1000e0 - 2e0 * (o_orderkey // 100) - 0.2e0 * (o_orderkey % 100) + 3e0 * (o_totalprice / 5e5) AS z,
           o_totalprice / 5e5 - 0.5e0 AS dz, a, s, a * power(s, 1.167e0) AS g, o_orderpriority AS soil, o_custkey AS custkey
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS a, avg(l_discount) * 10e0 AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _u(name: str, key: str = "i") -> str:
    return f"(cast(('0x' || substr(md5('42:{name}:' || {key}), 1, 13)) AS bigint) / 4503599627370496e0)"


def c_of(d: str, na: str, r: str) -> str:
    """The threshold equation in SQL, of diameter in m, roughness, and rate in m/s."""
    nb = f"(0.0474e0 * power(greatest({d}, 1e-12), 1e0 / 6e0))"
    return f"power((0.043e0 * 9.81e0 * 1650e0 * greatest({d}, 1e-12)) / greatest(9810e0 * power({nb}, 1.5e0) * power({nb} + greatest({na}, 0e0), -0.9e0) * power(greatest({r}, 1e-12), 0.6e0), 1e-12), 1e0 / 0.6e0)"


SAMPLES = f"""draws AS (
    SELECT i, exp(ln(2e0) - ln(1e0 + power(0.24e0, 2)) / 2 + sqrt(ln(1e0 + power(0.24e0, 2))) * sqrt(-2 * ln(1 - {_u('d50.u')})) * cos(2 * pi() * {_u('d50.v')})) AS d50_mm,
           0.015e0 + 0.085e0 * {_u('na')} AS na, 15e0 + 40e0 * {_u('r')} AS r_mm_hr FROM (SELECT unnest(range(1500)) AS i)),
samples AS (SELECT i, d50_mm, na, r_mm_hr, {c_of('(d50_mm / 1000e0)', 'na', '(r_mm_hr / 1000e0 / 3600e0)')} AS c FROM draws)"""

SCORED = """scored AS (SELECT cells.*, CASE WHEN g IS NOT NULL THEN (SELECT count(*) FROM samples WHERE samples.c <= cells.g) / 1500e0 END AS pci FROM cells)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the region of their customer as ``zone``."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = customer.join(F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)), customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("custkey"), F.col("r_name").alias("zone"))
    return cells(spark, sf_dir).join(place, "custkey")


ZONES = """zones AS (SELECT cells.*, r_name AS zone FROM cells JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("product"), F.col("user_id").alias("cid"), (F.col("event_id") % 32).alias("qa"), "ts", F.col("value").cast("double").alias("value"), "event_id")


SCENES = "scenes AS (SELECT event_type AS product, user_id AS cid, event_id % 32 AS qa, ts, value::double AS value, event_id FROM events)"
