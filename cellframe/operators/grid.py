"""Neighbours, flow, and connected components of cells, as joins and rounds of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered
from .shared import forget, kept, new_path

#: Fixed: offsets of the eight neighbours in order of preference, row by row, and of the four.
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [o for o in EIGHT if 0 in o]


def neighbours(cells: DataFrame, value: str, offsets=EIGHT) -> DataFrame:
    """``(cid, z, k, dist, nid, nz)``: each valid cell and its valid neighbours; ``k`` is the offset's place."""
    valid = cells.where(F.col(value).isNotNull()).select("cid", "r", "c", F.col(value).alias("z"))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit((dr * dr + dc * dc) ** 0.5).alias("dist")) for k, (dr, dc) in enumerate(offsets)])
    looks = valid.select("cid", "r", "c", "z", F.explode(table).alias("o")).select("cid", "z", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc"), "o.k", "o.dist")
    there = valid.select(F.col("cid").alias("nid"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("nz"))
    return looks.join(there, ["nr", "nc"]).select("cid", "z", "k", "dist", "nid", "nz")


def receivers(cells: DataFrame, value: str = "z", cell_size: float = 1.0, offsets=EIGHT) -> DataFrame:
    """``(cid, receiver, drop, slope)``: the neighbour of steepest descent; of equal drops the first offset's."""
    down = neighbours(cells, value, offsets).withColumn("drop", (F.col("z") - F.col("nz")) / F.col("dist")).where("drop > 0")
    best = down.groupBy("cid").agg(F.max_by("nid", F.struct("drop", -F.col("k"))).alias("receiver"), F.max("drop").alias("drop"))
    return best.withColumn("slope", F.col("drop") / float(cell_size))


def forest_sums(nodes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id, acc)``: what each node of a forest ``(id, acc, ptr)`` gathers from all that lead to it, itself counted, by pointer doubling.

    In each round a node adds what its pointer's sources gathered and pointers
    jump twice as far; rounds are the logarithm of the longest path.
    """
    state = kept(nodes.select("id", "acc", "ptr"))
    for _ in range(most_rounds):
        if not state.where("ptr IS NOT NULL").limit(1).count():
            return state.select("id", "acc")
        sent = state.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("id")).agg(F.sum("acc").alias("more"))
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        last, state = state, kept(state.join(sent, "id", "left").join(jump, "ptr", "left").select("id", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), F.col("far").alias("ptr")))
        forget(last)
    raise RuntimeError("flow has a cycle, or paths are too long")


def flow_accumulation(cells: DataFrame, flow: DataFrame) -> DataFrame:
    """``(cid, cells_up)``: cells that drain through each cell, itself counted, of receivers given as ids. Grids do it by tiles (``tiles.accumulated``)."""
    nodes = cells.join(flow.select("cid", "receiver"), "cid", "left").select(F.col("cid").alias("id"), F.lit(1).cast("long").alias("acc"), F.col("receiver").alias("ptr"))
    return forest_sums(nodes).select(F.col("id").alias("cid"), F.col("acc").alias("cells_up"))


def smallest_labels(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id, label)``: the smallest id that edges ``(a, b)`` connect each node to.

    In each round every node with edges points to its smallest neighbour, or to
    itself if it is smaller; pointers are followed to their ends, and edges are
    drawn between these. At least half of the nodes go in a round, so edges
    shrink fast; the nodes' own table is read once, at the end.
    """
    there = edges.where("a <> b").select("a", "b")
    live = kept(there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps = []
    for _ in range(most_rounds):
        if not live.limit(1).count():
            forget(live)
            labels = nodes.select("id", F.col("id").alias("label"))
            for step in steps:
                labels = labels.join(step.select(F.col("id").alias("label"), F.col("ptr").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            return labels
        step = flat_pointers(kept(live.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("ptr"))))
        steps.append(step)
        end = lambda side: step.select(F.col("id").alias(side), F.col("ptr").alias(f"{side}2"))  # noqa: B023, E731
        last, live = live, kept(live.join(end("a"), "a").join(end("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
        forget(last)
    raise RuntimeError("labels did not settle")


def components(mask: DataFrame, keys: list[str] | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """Cells of a mask with ``component``: 4-neighbour components, named by their first cell in row order.

    Runs of a row become spans; spans of adjacent rows that overlap are edges,
    so rounds are over spans, not cells. ``keys`` holds selections apart.
    ``cuts(r, c, down)`` are pairs of cells that don't touch: a cell and the one to its right, or below it. A cut ends a run; spans
    of adjacent rows touch if not every column that both have is cut.
    """
    keys = keys or []
    row = Window.partitionBy(*keys, "r").orderBy("c")
    run = F.col("c") - F.row_number().over(row)
    if cuts is None:
        runs = mask.select(*keys, "cid", "r", "c", run.alias("run"), F.lit(0).alias("ends"))
    else:
        # the cell after a cut begins a run
        ended = cuts.where("NOT down").select("r", (F.col("c") + 1).alias("c"), F.lit(1).alias("cut")).distinct()
        runs = mask.select(*keys, "cid", "r", "c").join(ended, ["r", "c"], "left")
        runs = runs.select(*keys, "cid", "r", "c", run.alias("run"), F.coalesce(F.sum("cut").over(row.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("ends"))
    named = F.min("cid").over(Window.partitionBy(*keys, "r", "run", "ends"))
    runs = kept(runs.withColumn("span", F.xxhash64(*keys, named) if keys else named))
    spans = kept(runs.groupBy(*keys, "r", "span").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("cid").alias("first")))
    tile = F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))).alias("tile")
    upper = spans.select(*keys, (F.col("r") + 1).alias("r"), F.col("span").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), tile)
    lower = spans.select(*keys, "r", F.col("span").alias("b"), "lo", "hi", tile)
    shared = F.least("ahi", "hi") - F.greatest("alo", "lo") + 1
    edges = upper.join(lower, [*keys, "r", "tile"]).where("alo <= hi AND lo <= ahi").select("a", "b", shared.alias("shared")).distinct()
    if cuts is not None:
        below = cuts.where("down").select("r", "c").distinct()
        over = below.join(runs.select(*keys, "r", "c", F.col("span").alias("a")), ["r", "c"]).withColumn("r", F.col("r") + 1)
        parted_ = over.join(runs.select(*keys, "r", "c", F.col("span").alias("b")), [*keys, "r", "c"]).groupBy("a", "b").agg(F.count("*").alias("gone"))
        edges = edges.join(parted_, ["a", "b"], "left").where(F.col("shared") > F.coalesce("gone", F.lit(0)))
    labels = smallest_labels(spans.select(F.col("span").alias("id")), edges.select("a", "b"))
    lead = spans.select("span", "first").join(labels.select(F.col("id").alias("span"), "label"), "span")
    names = lead.groupBy("label").agg(F.min("first").alias("component"))
    return runs.join(lead.select("span", "label").join(names, "label").select("span", "component"), "span").select(*keys, "cid", "r", "c", "component")


def component_sizes(parts: DataFrame, cell_area: float, least_area: float = 0.0, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Cells, area and, with ``value``, its statistics of each component with area at least ``least_area``."""
    stats = [F.avg(value).alias("pci_mean"), F.min(value).alias("pci_min"), F.max(value).alias("pci_max")] if value else []
    each = parts.groupBy(*(keys or []), "component").agg(F.count("*").alias("n_cells"), *stats)
    return each.withColumn("area_m2", F.col("n_cells") * float(cell_area)).where(F.col("area_m2") >= least_area)


def polygons(parts: DataFrame, cell_area: float, least_area: float = 0.0, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """``component_sizes`` with ids in order of the first cell, given after the filter."""
    keys = keys or []
    each = component_sizes(parts, cell_area, least_area, keys, value)
    ranked = numbered(each.withColumn("area_km2", F.col("area_m2") / 1e6), [*keys, "component"], "source_id")
    if keys:
        first = ranked.groupBy(*keys).agg(F.min("source_id").alias("_first"))
        ranked = ranked.join(F.broadcast(first), keys).withColumn("source_id", F.col("source_id") - F.col("_first") + 1).drop("_first")  # a row for each selection
    return ranked


#: Fixed: the four sides of a cell, each with its start, its end, and the neighbour beyond; the inside lies to the right, rows going down.
SIDES = [(0, 0, 1, 0, -1, 0), (1, 0, 1, 1, 0, 1), (1, 1, 0, 1, 1, 0), (0, 1, 0, 0, 0, -1)]


def outline_points(parts: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(component, ring, seq, x, y)``: the corners of each component's rings, in order, in cell units.

    Sides of cells without a neighbour in the component follow one another: at a
    corner where two components' cells touch a ring turns right, so that it
    stays with its cell. A ring's name is its smallest side, and a side's place
    follows from its distance to that one. Sides are followed inside tiles, and
    rings over tiles from chain to chain (``tiles.outline_points``), so no ring is
    walked in one task. Outer rings turn right, holes left.
    """
    from . import tiles

    return tiles.outline_points(parts, most_rounds)


#: Corners in a run of a ring.
RUN = 512


def ring_runs(points: DataFrame, run: int = RUN) -> DataFrame:
    """``(component, ring, part, points, next, n)``: each ring of ``outline_points`` as runs of at most ``run`` corners, in order from its first one.

    ``next`` is the corner after the run, the ring's first one after the last run; ``n`` is the ring's number of corners. Places come from ranks over all
    corners (range partitions and prefix sums), so that no ring is put in order in one task, however long it is.
    """
    first = F.when(F.col("seq") == 0, F.lit(-(1 << 62))).otherwise(F.col("seq"))  # a ring's first side has no distance to itself
    ranked = kept(numbered(points.withColumn("turn", first), ["component", "ring", "turn"], "rank"))
    bounds = kept(ranked.groupBy("component", "ring").agg(F.min("rank").alias("base"), F.count("*").alias("n")))
    placed = ranked.join(bounds, ["component", "ring"]).withColumn("at", F.col("rank") - F.col("base"))
    corner = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    each = placed.groupBy("component", "ring", "n", F.floor(F.col("at") / run).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", corner.alias("p")))), lambda e: e["p"]).alias("points"))
    each = kept(each)
    parts = F.ceil(F.col("n") / run)
    begins = each.select("component", "ring", F.pmod(F.col("part") - 1, parts).alias("part"), F.get("points", F.lit(0)).alias("next"))
    return each.join(begins, ["component", "ring", "part"]).select("component", "ring", "part", "points", "next", "n")


def run_measures(runs: DataFrame) -> DataFrame:
    """``(component, ring, hole, area, length)`` of each ring, summed over its runs: in cell units, a hole's area less than 0."""
    after = F.concat(F.slice("points", 2, F.size("points")), F.array("next"))
    cross = F.aggregate(F.zip_with("points", after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v)
    far = F.aggregate(F.zip_with("points", after, lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)), F.lit(0.0), lambda t, v: t + v)
    out = runs.select("component", "ring", cross.alias("cross"), far.alias("far")).groupBy("component", "ring").agg((F.sum("cross") / 2).alias("area"), F.sum("far").alias("length"))
    return out.select("component", "ring", (F.col("area") < 0).alias("hole"), "area", "length")


def run_texts(runs: DataFrame) -> DataFrame:
    """``(component, geometry)``: polygons as well-known text, shells before holes, put together from the texts of their runs.

    A row is as long as its polygon's outline, as a text of it has to be; everything before it is held in runs.
    """
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    place = lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))
    holes = run_measures(runs).select("component", "ring", "hole")
    text = F.array_join(F.transform("points", place), ", ")
    each = runs.select("component", "ring", "part", text.alias("text"), place(F.col("next")).alias("close"))
    rings = each.groupBy("component", "ring").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda e: e["text"]), ", ").alias("text"), F.max_by("close", "part").alias("close"))
    named = rings.join(holes, ["component", "ring"]).select("component", F.struct("hole", "ring", F.concat(F.lit("("), "text", F.lit(", "), "close", F.lit(")")).alias("text")).alias("e"))
    return named.groupBy("component").agg(F.concat(F.lit("POLYGON ("), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["text"]), ", "), F.lit(")")).alias("geometry"))


def outlines(points: DataFrame) -> DataFrame:
    """``(component, rings)``: each component's outer ring and then its holes, as arrays of ``{x, y}``. A row is as long as its outline."""
    # the ring's first side has no distance to itself, and is its start
    order = F.struct(F.when(F.col("seq") == 0, F.lit(-(1 << 62))).otherwise(F.col("seq")).alias("k"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    rings = points.groupBy("component", "ring").agg(F.transform(F.sort_array(F.collect_list(order)), lambda e: e["p"]).alias("points"))
    follow = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    turn = F.aggregate(F.zip_with("points", follow, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    named = rings.withColumn("hole", turn < 0)
    return named.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("hole", "ring", "points"))), lambda e: e["points"]).alias("rings"))


def well_known_text(rings: str = "rings") -> Column:
    """A polygon's rings as well-known text, each one closed."""
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def crossed_cells(lines: DataFrame, height: int, width: int) -> DataFrame:
    """``(r, c)``: cells of a grid that polylines ``(points array<struct<x,y>>)``, in cell units, pass through."""
    pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    each = lines.select(F.explode(pairs).alias("s")).select("s.*")
    low, high = F.greatest(F.floor(F.least("y0", "y1")), F.lit(0)), F.least(F.floor(F.greatest("y0", "y1")), F.lit(height - 1))
    rows = each.where(low <= high).withColumn("r", F.explode(F.sequence(low, high)))
    at = lambda y: F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.when(F.col("y0") != F.col("y1"), F.col("y1") - F.col("y0"))))
    top, bottom = F.greatest(F.least("y0", "y1"), F.col("r").cast("double")), F.least(F.greatest("y0", "y1"), F.col("r") + 1.0)
    flat = F.col("y0") == F.col("y1")
    one, two = F.when(flat, F.col("x0")).otherwise(at(top)), F.when(flat, F.col("x1")).otherwise(at(bottom))
    lo, hi = F.greatest(F.floor(F.least(one, two)), F.lit(0)), F.least(F.floor(F.greatest(one, two)), F.lit(width - 1))
    return rows.where(lo <= hi).select("r", F.explode(F.sequence(lo, hi)).alias("c")).distinct()


def parted(area: DataFrame, barriers: DataFrame) -> DataFrame:
    """The parts into which barrier cells cut an area's cells, as ``components``; cells of the barriers are in none."""
    return components(area.select("cid", "r", "c").join(barriers.select("r", "c").distinct(), ["r", "c"], "left_anti").select("cid", "r", "c"))


def cut_sides(lines: DataFrame, height: int, width: int) -> DataFrame:
    """``(r, c, down)``: the pairs of neighbouring cells of a grid whose centres polylines ``(points array<struct<x,y>>)``, in cell units, part.

    Each segment is met with the rows, and the columns, of centres that it passes, so rows follow a line's length in cells. A centre on a line counts as
    if it lay a little to the left, and, by far less, above: lines leave no gap where they touch centres or each other.
    """
    ends = lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
    n = F.greatest(F.size("points") - 1, F.lit(0))
    each = lines.select(F.explode(F.zip_with(F.slice("points", 1, n), F.slice("points", 2, n), ends)).alias("s")).select("s.*")

    def passed(u: str, v: str, most: int) -> DataFrame:
        """For each centre between the segment's ends along ``u``: its number, and the number of the centre before the crossing along ``v``."""
        u0, u1, v0, v1 = (F.col(f"{k}{e}") for k in (u, v) for e in (0, 1))
        first = F.greatest(F.floor(F.least(u0, u1) - 0.5) + 1, F.lit(0))
        last = F.least(F.floor(F.greatest(u0, u1) - 0.5), F.lit(most - 1))
        met = each.where((u0 != u1) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
        v = v0 + (F.col("k") + 0.5 - u0) * (v1 - v0) / (u1 - u0) - 0.5
        # a little to the left, a line that falls to the right is higher up than at the centre itself
        return met.select("k", F.when((v1 != v0) & ((v1 > v0) == (u1 > u0)), F.ceil(v) - 1).otherwise(F.floor(v)).alias("m") if u == "x" else F.floor(v).alias("m"))

    across = passed("y", "x", height).select(F.col("k").alias("r"), F.col("m").alias("c"), F.lit(False).alias("down")).where((F.col("c") >= 0) & (F.col("c") < width - 1))
    along = passed("x", "y", width).select(F.col("m").alias("r"), F.col("k").alias("c"), F.lit(True).alias("down")).where((F.col("r") >= 0) & (F.col("r") < height - 1))
    return across.unionByName(along).distinct()


def divided(area: DataFrame, lines: DataFrame, height: int, width: int) -> DataFrame:
    """The parts into which contact lines cut an area: each of its cells is in one, since lines run between cells (``cut_sides``)."""
    return components(area.select("cid", "r", "c"), cuts=kept(cut_sides(lines, height, width)))


def without_holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """A mask and those parts of its complement that don't touch the grid's border."""
    spark = mask.sparkSession
    every = spark.range(height * width).select(F.col("id").alias("cid"), F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c"))
    rest = components(every.join(mask.select("cid"), "cid", "left_anti"))
    edge = (F.col("r") == 0) | (F.col("r") == height - 1) | (F.col("c") == 0) | (F.col("c") == width - 1)
    open_parts = rest.where(edge).select("component").distinct()
    return mask.select("cid", "r", "c").unionByName(rest.join(open_parts, "component", "left_anti").select("cid", "r", "c"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges in both directions, repeats kept."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbour_means(nodes: DataFrame, edges: DataFrame, features: list[str], hops: int = 2) -> DataFrame:
    """Means of features over incoming edges, 0 without any, and of those means for each further hop."""
    out, now = nodes, features
    for hop in range(1, hops + 1):
        values = out.select(F.col("id").alias("src"), *now)
        means = edges.join(values, "src").groupBy("dst").agg(*[F.avg(f).alias(f"{f}_h") for f in now])
        fresh = [f"{f}_{hop}" for f in features]
        means = means.select(F.col("dst").alias("id"), *[F.col(f"{f}_h").alias(g) for f, g in zip(now, fresh, strict=True)])
        out = out.join(means, "id", "left").fillna(0.0, fresh)
        now = fresh
    return out


def flat_pointers(state: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id, ptr)`` with each pointer followed to its end, twice as far in each round."""
    for _ in range(most_rounds):
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"))
        new = kept(state.join(jump, "ptr").select("id", F.col("far").alias("ptr"), (F.col("far") != F.col("ptr")).alias("moved")))
        forget(state)
        state = new.select("id", "ptr")
        if not new.where("moved").limit(1).count():
            return state
    raise RuntimeError("pointers did not settle")


OUT = -1


def spill_levels(basins: DataFrame, passes: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(basin, comp, level)``: the lowest level at which each basin spills to the outside, basin ``OUT``.

    In each round every group of basins takes its lowest pass to another group;
    whoever leaves it has to rise to that pass, and beyond the pass the other
    group's level counts. Groups that are so linked become one, so their number
    at least halves; the level is the highest pass that was taken on the way.
    Passes are ordered by height and ends, so links form no cycle but pairs. A
    basin whose group has no pass left, and isn't outside, ends with its group's name as ``comp``.
    """
    state = kept(basins.select("basin", F.col("basin").alias("comp"), F.lit(float("-inf")).alias("level")))
    edges = kept(passes.select(F.col("basin").alias("a"), F.col("other").alias("b"), "pass"))
    for _ in range(most_rounds):
        choice = F.struct("pass", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "b")
        pick = kept(edges.where(F.col("a") != OUT).groupBy("a").agg(F.min(choice).alias("p")).select(F.col("a").alias("comp"), F.col("p.b").alias("to"), F.col("p.pass").alias("rise")))
        if not pick.limit(1).count():
            forget(edges)
            return state
        # of two groups that took the same pass the one with the smaller name is the end; what it rose to, both rise to
        back = pick.select(F.col("comp").alias("to"), F.col("to").alias("again"))
        links = pick.join(back, "to", "left").select("comp", "rise", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("ptr"))
        ends = links.select(F.col("ptr").alias("comp")).distinct().join(links.select("comp"), "comp", "left_anti").select("comp", F.lit(float("-inf")).alias("rise"), F.col("comp").alias("ptr"))
        walk = kept(links.unionByName(ends))
        for _ in range(most_rounds):
            jump = walk.select(F.col("comp").alias("ptr"), F.col("ptr").alias("far"), F.col("rise").alias("more"))
            new = kept(walk.join(jump, "ptr").select("comp", F.when(F.col("ptr") == F.col("comp"), F.col("rise")).otherwise(F.greatest("rise", "more")).alias("rise"), F.col("far").alias("ptr"), (F.col("far") != F.col("ptr")).alias("moved")))
            forget(walk)
            walk = new.select("comp", "rise", "ptr")
            if not new.where("moved").limit(1).count():
                break
        else:
            raise RuntimeError("links did not settle")
        last, state = state, kept(state.join(walk, "comp", "left").select("basin", F.coalesce("ptr", "comp").alias("comp"), F.greatest("level", F.coalesce("rise", F.lit(float("-inf")))).alias("level")))
        now = lambda side: walk.select(F.col("comp").alias(side), F.col("ptr").alias(f"{side}2"))
        moved = edges.join(now("a"), "a", "left").withColumn("a", F.coalesce("a2", "a")).drop("a2")
        inner = moved.where(F.col("b") != OUT).join(now("b"), "b", "left").withColumn("b", F.coalesce("b2", "b")).drop("b2")
        old, edges = edges, kept(inner.unionByName(moved.where(F.col("b") == OUT), allowMissingColumns=False).where("a <> b").groupBy("a", "b").agg(F.min("pass").alias("pass")))
        for done in (last, old, walk, pick):
            forget(done)
    raise RuntimeError("levels did not settle")


def filled(cells: DataFrame, value: str = "z") -> DataFrame:
    """``cells`` with ``filled``: sinks raised to the level at which they spill to the grid's edge.

    Tiles are flooded from their borders, and only the basins that a border cell
    names, and the passes between them, meet in rounds (``tiles.filled``).
    """
    from . import tiles

    return tiles.filled(cells, value)


def drained(cells: DataFrame, value: str = "filled") -> DataFrame:
    """``(cid, receiver)`` of a filled surface: steepest descent, and across flats the neighbour nearest to a way down.

    Flats are crossed a cell in each round, from their ways down; a round reads
    the flat cells that are left and adds its own to the result, so that cells
    elsewhere aren't touched again.
    """
    touch = kept(neighbours(cells, value))
    edge = cells.join(touch.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").where(F.coalesce("n", F.lit(0)) < 8).select("cid")
    steep = touch.withColumn("drop", (F.col("z") - F.col("nz")) / F.col("dist")).where("drop > 0").groupBy("cid").agg(F.max_by("nid", F.struct("drop", -F.col("k"))).alias("receiver"))
    spark, path = cells.sparkSession, new_path(cells.sparkSession)
    cells.select("cid").join(steep, "cid", "left").join(edge.withColumn("edge", F.lit(True)), "cid", "left").where("receiver IS NOT NULL OR edge").select("cid", "receiver").write.parquet(path)
    done = spark.read.parquet(path)
    flat = kept(touch.where("z = nz").select("cid", "nid", "k").join(done.select("cid"), "cid", "left_anti"))
    front = done.select("cid")
    while True:
        step = kept(flat.join(front.select(F.col("cid").alias("nid")), "nid", "left_semi").groupBy("cid").agg(F.min_by("nid", "k").alias("receiver")))
        if not step.limit(1).count():
            forget(touch)
            forget(flat)
            return spark.read.parquet(path)
        step.write.mode("append").parquet(path)
        last, flat = flat, kept(flat.join(step.select("cid"), "cid", "left_anti"))
        forget(last)
        front = step.select("cid")
