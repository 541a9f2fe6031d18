"""Bands warped from one grid to another, of other axes or another reference system."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let, utm_forward, utm_inverse


@dataclass(frozen=True)
class Grid:
    """A grid's header: ``height`` x ``width`` cells placed by ``x = x0 + dx * c + rx * r`` and ``y = y0 + ry * c + dy * r``, of cell corners.

    ``zone`` is the zone, 1 to 60, of metres east and north (south of the
    equator north is below 0); None means degrees of longitude and latitude.
    """

    height: int
    width: int
    x0: float
    y0: float
    dx: float
    dy: float
    rx: float = 0.0
    ry: float = 0.0
    zone: int | None = None

    def __post_init__(self):
        if self.height < 1 or self.width < 1:
            raise ValueError("a grid has rows and columns")
        if self.dx * self.dy - self.rx * self.ry == 0:
            raise ValueError("the axes of a grid must not be parallel")
        if self.zone is not None and not 1 <= self.zone <= 60:
            raise ValueError("a zone is 1 to 60")

    def place(self, r: Column, c: Column) -> tuple[Column, Column]:
        """Where a row and column, or parts of them, lie."""
        return self.x0 + self.dx * c + self.rx * r, self.y0 + self.ry * c + self.dy * r

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The row and column, with their parts, of a place."""
        turn, u, v = self.dx * self.dy - self.rx * self.ry, x - self.x0, y - self.y0
        return (self.dx * v - self.ry * u) / turn, (self.dy * u - self.rx * v) / turn


def between(source: Grid, target: Grid, r: Column, c: Column) -> Column:
    """``{y, x}``: the row and column on ``source`` of a row and column of ``target``, with their parts."""

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def found(p: Column) -> Column:
        row, column = source.cell(p["x"], p["y"])
        return F.struct(row.alias("y"), column.alias("x"))

    at = point(*target.place(r, c))
    if source.zone != target.zone:
        if target.zone is not None:
            at = let(let(at, lambda p: utm_inverse(p["x"], p["y"], F.lit(target.zone))), lambda p: point(p["lon"], p["lat"]))
        if source.zone is not None:
            at = let(at, lambda p: point(*utm_forward(p["x"], p["y"], F.lit(source.zone))[1:]))
    return let(at, found)


def warped(cells: DataFrame, value: str, source: Grid, target: Grid, method: str = "nearest", template: DataFrame | None = None) -> DataFrame:
    """``(r, c, value)`` of each cell of ``target``, or of those that ``template(r, c)`` lists, from ``cells(r, c, value)`` of ``source``.

    ``nearest`` takes the source cell that holds the target cell's centre.
    ``bilinear`` weighs the four source cells around the centre by nearness;
    it doesn't widen where target cells are larger than source cells. ``average``
    weighs source cells by their share of the upright box around the target
    cell's corners. All leave null and NaN source cells out; a cell whose centre
    (``average``: whose box) is off the source grid, or meets no valid cell, is null.

    A source cell is there once; cells beyond the header are left out. Cells off the source keep their own keys, so that they meet
    nothing and share no key. The target's places are column expressions, so each target cell is shuffled once, onto
    the key that source cells are on; for ``bilinear`` the source is first put in fours on that key. ``average`` sends a row for each
    source cell of a box: use it for target cells that aren't much smaller than source cells.
    """
    if method not in ("nearest", "bilinear", "average"):
        raise ValueError(f"unknown method {method}")
    v = F.col(value).cast("double")
    there = F.col("r").between(0, source.height - 1) & F.col("c").between(0, source.width - 1)
    valid = cells.where(there & v.isNotNull() & ~F.isnan(v)).select(F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), v.alias("v"))
    if template is None:
        to = cells.sparkSession.range(target.height * target.width).select(F.floor(F.col("id") / target.width).alias("r"), (F.col("id") % target.width).alias("c"))
    else:
        to = template.where(F.col("r").between(0, target.height - 1) & F.col("c").between(0, target.width - 1)).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    if method == "average":
        return _averaged(valid, source, target, to)
    to = to.withColumn("at", between(source, target, F.col("r") + 0.5, F.col("c") + 0.5)).select("r", "c", "at.y", "at.x")
    on = (F.col("y") >= 0) & (F.col("y") < source.height) & (F.col("x") >= 0) & (F.col("x") < source.width)
    if method == "nearest":
        at = to.withColumn("sr", F.floor("y")).withColumn("sc", F.floor("x"))
        return at.join(valid, ["sr", "sc"], "left").select("r", "c", F.when(on, F.col("v")).alias("value"))
    corners = F.array(*[F.struct((F.col("sr") - i).alias("sr"), (F.col("sc") - j).alias("sc"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)])
    fours = valid.select("v", F.explode(corners).alias("q")).groupBy("q.sr", "q.sc").agg(*[F.max(F.when(F.col("q.k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    at = to.withColumn("sr", F.floor(F.col("y") - 0.5)).withColumn("sc", F.floor(F.col("x") - 0.5))
    met = at.join(fours, ["sr", "sc"], "left")
    down, right = F.col("y") - 0.5 - F.col("sr"), F.col("x") - 0.5 - F.col("sc")
    weight = [(1 - down) * (1 - right), (1 - down) * right, down * (1 - right), down * right]
    total = lambda of: sum((F.coalesce(of(k, w), F.lit(0.0)) for k, w in enumerate(weight)), F.lit(0.0))
    known = total(lambda k, w: F.when(F.col(f"v{k}").isNotNull(), w))
    return met.select("r", "c", F.when(on & (known > 0), total(lambda k, w: w * F.col(f"v{k}")) / known).alias("value"))


def _averaged(valid: DataFrame, source: Grid, target: Grid, to: DataFrame) -> DataFrame:
    corners = [between(source, target, F.col("r") + i, F.col("c") + j) for i in (0.0, 1.0) for j in (0.0, 1.0)]

    def box(four: Column) -> Column:
        ends = lambda name, size: (F.greatest(F.array_min(F.transform(four, lambda p: p[name])), F.lit(0.0)), F.least(F.array_max(F.transform(four, lambda p: p[name])), F.lit(float(size))))
        (top, bottom), (left, right) = ends("y", source.height), ends("x", source.width)
        return F.struct(top.alias("y_lo"), bottom.alias("y_hi"), left.alias("x_lo"), right.alias("x_hi"))

    def span(name: str) -> Column:
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.explode_outer(F.when(low < high, F.sequence(F.floor(low), F.ceil(high) - 1)))

    boxes = to.select("r", "c", let(F.array(*corners), box).alias("box")).select("r", "c", "box.*")
    each = boxes.withColumn("sr", span("y")).withColumn("sc", span("x"))
    share = lambda name, at: F.least(F.col(f"{name}_hi"), F.col(at) + 1.0) - F.greatest(F.col(f"{name}_lo"), F.col(at).cast("double"))
    got = each.select("r", "c", "sr", "sc", (share("y", "sr") * share("x", "sc")).alias("w")).join(valid, ["sr", "sc"]).groupBy("r", "c").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("value"))
    return to.select("r", "c").join(got, ["r", "c"], "left")
