"""Neighbour work on square tiles of cells: each tile gets its neighbours' border strips, and arrays do the rest.

Cells are dealt to tiles once; those within ``halo`` of a border go to the tiles beyond it too, so what is
shuffled is the cells and a strip for each border. A task holds one tile at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import EIGHT, FOUR, OUT, SIDES, forest_sums, spill_levels
from .shared import forget, kept

#: Cells on a side of a tile.
SIZE = 256
#: Codes of a cell's way besides the places 0 to 7 of ``EIGHT``: it ends here, there is no cell, it isn't known yet.
END, NONE, OPEN = -1, -2, -3
FAR = np.iinfo(np.int32).max


class Tile:
    """A tile's bands as arrays of ``size + 2 * halo`` cells a side, NaN where there is no cell; ``ids`` are -1 there."""

    def __init__(self, tr: int, tc: int, size: int, halo: int, ids: np.ndarray, bands: dict[str, np.ndarray]):
        self.tr, self.tc, self.size, self.halo, self.ids, self.bands = tr, tc, size, halo, ids, bands

    def own(self, a: np.ndarray, dr: int = 0, dc: int = 0) -> np.ndarray:
        """The tile's own part of an array, or the part as large that lies ``(dr, dc)`` beside it."""
        h = self.halo
        return a[h + dr : h + dr + self.size, h + dc : h + dc + self.size]


def steps(a: np.ndarray, offsets, missing) -> Iterator[tuple[int, float, np.ndarray]]:
    """For each offset its place, its length, and the array moved so that each cell holds its neighbour's value."""
    wide = np.pad(a, 1, constant_values=missing)
    for k, (dr, dc) in enumerate(offsets):
        yield k, (dr * dr + dc * dc) ** 0.5, wide[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]]


def on_tiles(cells: DataFrame, bands: list[str], work: Callable[[Tile], dict], schema: str, halo: int = 1, size: int = SIZE) -> DataFrame:
    """``work`` on each tile of ``cells(cid, r, c, bands)``; it gives columns of the schema. A cell with a null band has NaN there.

    Keys are places in the grid, so no tile is larger than ``(size + 2 * halo)`` squared and none is hot.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, side = to_arrow_schema(StructType.fromDDL(schema)), size + 2 * halo
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    dealt = cells.select("cid", "r", "c", *[F.col(b).cast("double").alias(b) for b in bands]).withColumn("tr", F.explode(reach("r"))).withColumn("tc", F.explode(reach("c")))

    def run(key, table):
        tr, tc = (k.as_py() for k in key)
        column = lambda n: table[n].to_numpy()
        at = column("r") - tr * size + halo, column("c") - tc * size + halo
        ids = np.full((side, side), -1, np.int64)
        ids[at] = column("cid")
        arrays = {}
        for b in bands:
            arrays[b] = np.full((side, side), np.nan)
            arrays[b][at] = column(b)
        tile = Tile(tr, tc, size, halo, ids, arrays)
        if (tile.own(ids) < 0).all():  # strips alone
            return arrow.empty_table()
        out = work(tile)
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return dealt.groupBy("tr", "tc").applyInArrow(run, schema)


def steepest(z: np.ndarray, offsets=EIGHT) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of an array the place of the offset of steepest descent, of equal drops the first (-1: none), and the drop."""
    way, drop = np.full(z.shape, END, np.int8), np.zeros(z.shape)
    for k, length, near in steps(z, offsets, np.nan):
        down = (z - near) / length
        more = down > drop  # False where either is missing
        way[more], drop[more] = k, down[more]
    return way, drop


def receivers(cells: DataFrame, value: str = "z", cell_size: float = 1.0, offsets=EIGHT, size: int = SIZE) -> DataFrame:
    """``(cid, receiver, k, drop, slope)``: the neighbour of steepest descent and the place of its offset, for cells that have one."""

    def work(tile: Tile) -> dict:
        way, drop = steepest(tile.bands[value], offsets)
        way, drop = tile.own(way), tile.own(drop)
        here = (way >= 0) & (tile.own(tile.ids) >= 0)
        to = np.full(way.shape, -1, np.int64)
        for k, (dr, dc) in enumerate(offsets):
            to[way == k] = tile.own(tile.ids, dr, dc)[way == k]
        return {"cid": tile.own(tile.ids)[here], "receiver": to[here], "k": way[here].astype(np.int32), "drop": drop[here], "slope": drop[here] / cell_size}

    return on_tiles(cells, [value], work, "cid long, receiver long, k int, drop double, slope double", 1, size)


def neighbour_means(cells: DataFrame, value: str, hops: int = 2, offsets=FOUR, size: int = SIZE) -> DataFrame:
    """``(id, value, value_1, ..)``: each valid cell's mean over its valid neighbours, 0 without any, and of those means for each further hop."""

    def work(tile: Tile) -> dict:
        now = tile.bands[value]
        valid = ~np.isnan(now)
        here = tile.own(valid) & (tile.own(tile.ids) >= 0)
        out = {"id": tile.own(tile.ids)[here], value: tile.own(now)[here]}
        for hop in range(1, hops + 1):
            total, n = np.zeros(now.shape), np.zeros(now.shape)
            for _, _, near in steps(now, offsets, np.nan):
                there = ~np.isnan(near)
                total[there] += near[there]
                n += there
            now = np.where(valid, total / np.maximum(n, 1), np.nan)
            out[f"{value}_{hop}"] = tile.own(now)[here]
        return out

    return on_tiles(cells, [value], work, f"id long, {value} double, " + ", ".join(f"{value}_{h} double" for h in range(1, hops + 1)), hops, size)


FLOW = "tr long, tc long, ids binary, way binary"


def packed(ids: np.ndarray) -> bytes:
    """Ids as the steps between them: equal bytes, which compress, where ids follow one another."""
    return np.diff(ids.ravel(), prepend=np.int64(0)).tobytes()


def unpacked(steps_: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps_, np.int64))


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which two arrays of doubles differ, zeros where they are equal; with one of them they give the other."""
    return np.ascontiguousarray(a).ravel().view(np.int64) ^ np.ascontiguousarray(b).ravel().view(np.int64)


def _flow_row(tile: Tile, ids: np.ndarray, way: np.ndarray) -> dict:
    return {"tr": [tile.tr], "tc": [tile.tc], "ids": [packed(ids)], "way": [np.ascontiguousarray(way).tobytes()]}


def flow_of_descent(cells: DataFrame, value: str = "z", offsets=EIGHT, size: int = SIZE) -> DataFrame:
    """Flow tiles ``(tr, tc, ids, way)``, a row each: where each cell's water goes by steepest descent. ``way`` has places of ``EIGHT``."""
    names = np.array([EIGHT.index(o) for o in offsets] + [END], np.int8)

    def work(tile: Tile) -> dict:
        ids = tile.own(tile.ids)
        way = names[tile.own(steepest(tile.bands[value], offsets)[0])]
        return _flow_row(tile, ids, np.where(ids < 0, NONE, way).astype(np.int8))

    return on_tiles(cells, [value], work, FLOW, 1, size)


def flow_rows(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """``(cid, k)`` of flow tiles: each cell and the place of its way's offset, null where it ends."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, way = unpacked(row["ids"]), np.frombuffer(row["way"], np.int8)
                ids, way = ids[way != NONE], way[way != NONE]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(way.astype(np.int32), mask=way < 0)], names=["cid", "k"])

    return tiles.select("ids", "way").mapInArrow(run, "cid long, k int")


def inside(way: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell's target inside the tile (-1: none), whether its way leaves the tile, and the offset (rows, columns) of its way."""
    step = np.array([*EIGHT, (0, 0), (0, 0), (0, 0)])[way.astype(int)]  # codes below 0 count from the end
    at = np.stack(np.divmod(np.arange(size * size), size), 1) + step
    out = (way >= 0) & ((at < 0) | (at >= size)).any(1)
    return np.where((way >= 0) & ~out, at[:, 0] * size + at[:, 1], -1), out, step


def gathered(target: np.ndarray, weight: np.ndarray, there: np.ndarray) -> np.ndarray:
    """What each cell gathers from all cells that lead to it, itself counted: cells without open sources hand on what they have, again and again."""
    waits = np.bincount(target[target >= 0], minlength=len(target))
    out, front, done = weight.copy(), np.flatnonzero((waits == 0) & there), 0
    while len(front):
        done += len(front)
        to = target[front]
        front, to = front[to >= 0], to[to >= 0]
        np.add.at(out, to, out[front])
        np.subtract.at(waits, to, 1)
        front = np.unique(to[waits[to] == 0])
    if done < there.sum():
        raise ValueError("flow has a cycle")
    return out


def ends(target: np.ndarray) -> np.ndarray:
    """Where each cell's way inside the tile ends."""
    at = np.where(target >= 0, target, np.arange(len(target)))
    while (at != (far := at[at])).any():
        at = far
    return at


def accumulated(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """``(cid, cells_up)`` of flow tiles: cells that drain through each cell, itself counted.

    Each tile gathers inside itself and is then contracted to its border: a cell whose way leaves the tile carries what
    it gathered, and leads to the border cell where the way on from its receiver leaves the next tile. That weighted forest of
    border cells is summed by rounds (``grid.forest_sums``); the sums flow into the tiles once more, which gather again.
    All cells are read twice, however long their ways are. A cycle raises.
    """

    def back(batches):
        for batch in batches:
            for row in batch.to_pylist():
                total, there = refilled(row, size)
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(row["ids"])[there]), pa.array(total[there])], names=["cid", "cells_up"])

    return tiles.join(inflows(tiles, size), ["tr", "tc"], "left").select("ids", "way", "flows").mapInArrow(back, "cid long, cells_up long")


def refilled(row: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a flow tile with its inflows: cells that drain through each cell, and where there is one."""
    way = np.frombuffer(row["way"], np.int8)
    there = way != NONE
    weight = there.astype(np.int64)
    for f in row["flows"] or ():
        weight[f["at"]] += f["more"]
    return gathered(inside(way, size)[0], weight, there), there


def inflows(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """``(tr, tc, flows)``, written: what flow tiles ``(tr, tc, way)`` get from other tiles, at most one flow for each border cell."""
    place = lambda r, c: r * (1 << 32) + c
    ring = np.zeros((size, size), bool)
    ring[[0, -1], :] = ring[:, [0, -1]] = True
    ring = np.flatnonzero(ring.ravel())

    def borders(batches):
        for batch in batches:
            for row in batch.to_pylist():
                way = np.frombuffer(row["way"], np.int8)
                target, out, step = inside(way, size)
                total, end = gathered(target, (way != NONE).astype(np.int64), way != NONE), ends(target)
                at = ring[way[ring] != NONE]
                r, c = at // size + row["tr"] * size, at % size + row["tc"] * size
                last = end[at]
                leaves, goes = out[at], out[last]
                name = place(last // size + row["tr"] * size, last % size + row["tc"] * size)
                yield pa.RecordBatch.from_arrays([pa.array(place(r, c)), pa.array(name, mask=~goes), pa.array(total[at], mask=~leaves), pa.array(place(r + step[at, 0], c + step[at, 1]), mask=~leaves)], names=["id", "end", "acc", "to"])

    edge = kept(tiles.select("tr", "tc", "way").mapInArrow(borders, "id long, end long, acc long, to long"))
    on = edge.select(F.col("id").alias("to"), F.col("end").alias("ptr"))
    leaving = kept(edge.where("to IS NOT NULL").select("id", "acc", "to").join(on, "to", "left"))
    sums = forest_sums(leaving.select("id", "acc", "ptr"))
    row_of = F.shiftright("to", 32)
    column_of = F.col("to").bitwiseAND((1 << 32) - 1)
    into = leaving.select("id", "to").join(sums.select("id", "acc"), "id").groupBy("to").agg(F.sum("acc").alias("more"))
    into = into.select(F.floor(row_of / size).alias("tr"), F.floor(column_of / size).alias("tc"), F.struct((row_of % size * size + column_of % size).cast("int").alias("at"), "more").alias("f"))
    return kept(into.groupBy("tr", "tc").agg(F.collect_list("f").alias("flows")))


def spread(level: np.ndarray, z: np.ndarray, open_: np.ndarray, offsets=EIGHT) -> np.ndarray:
    """Steps to the nearest way down of the open cells of an array, through neighbours of equal height, from levels known so far.

    Fronts of equal distance are taken nearest first; a level from outside joins the front of its distance, unless a shorter way came first.
    """
    rows, width = level.shape
    flat, height, free, start = level.ravel().copy(), z.ravel(), open_.ravel(), level.ravel()
    known = np.flatnonzero(start < FAR)
    known = known[np.argsort(start[known], kind="stable")]
    begins, at, now, front = start[known], 0, 0, np.empty(0, np.int64)
    while len(front) or at < len(known):
        now = now if len(front) else int(begins[at])
        upto = int(np.searchsorted(begins, now, "right"))
        same = known[at:upto]
        front, at = np.concatenate([front, same[flat[same] == begins[at:upto]]]), upto
        r, c = np.divmod(front, width)
        found = []
        for dr, dc in offsets:
            ok = (r + dr >= 0) & (r + dr < rows) & (c + dc >= 0) & (c + dc < width)
            of = front[ok]
            to = of + dr * width + dc
            found.append(to[free[to] & (height[to] == height[of]) & (flat[to] > now + 1)])
        front, now = np.unique(np.concatenate(found)), now + 1
        flat[front] = now
    return flat.reshape(rows, width)


def drained(cells: DataFrame, value: str = "filled", offsets=EIGHT, size: int = SIZE, most_rounds: int = 10_000) -> DataFrame:
    """Flow tiles of a filled surface: steepest descent, and across flats to the neighbour that is nearest to a way down.

    A cell is done if it has a lower neighbour or lies at an edge of the valid cells (its way ends there); a flat's other cells go to
    a neighbour of their height that is one step nearer to a done cell, of equal ones the first offset's. Distances are
    spread inside each tile at once, then border cells whose distance fell are sent to the tiles beyond, which spread again: rounds follow the
    number of tiles that a flat crosses, not of cells, and tiles that hold no open cell take part in none. A flat without a way out ends in itself.
    """
    start = kept(on_tiles(cells, [value], flat_start(value, value, offsets, size), START, 2, size))
    return kept(start.select("tr", "tc", "ids").join(ways_over_flats(start, offsets, size, most_rounds), ["tr", "tc"]))


START = f"{FLOW}, z binary, raw binary, level binary"


def flat_start(value: str, raw: str, offsets, size: int) -> Callable[[Tile], dict]:
    """Work on a tile of halo 2: its flow by steepest descent, its surface ``z`` with a halo of one cell, what ``raw`` differs from it, and levels if it has open cells."""
    names = np.array([EIGHT.index(o) for o in offsets] + [END], np.int8)

    def first(tile: Tile) -> dict:
        z = tile.bands[value]
        way, _ = steepest(z, offsets)
        n = sum((~np.isnan(near)).astype(int) for _, _, near in steps(z, EIGHT, np.nan))
        open_ = (way == END) & (n == 8)
        # one cell of the halo is left, whose own neighbours are known
        cut = lambda a: a[1:-1, 1:-1]
        level = np.where(cut(open_), FAR, 0).astype(np.int32)
        level[np.isnan(cut(z))] = FAR
        ids = tile.own(tile.ids)
        code = np.where(ids < 0, NONE, np.where(tile.own(open_), OPEN, names[tile.own(way)])).astype(np.int8)
        flat = bool((code == OPEN).any())
        held = {"z": np.ascontiguousarray(cut(z)).tobytes(), "raw": unlike(tile.own(z), tile.own(tile.bands[raw])).tobytes(), "level": level.tobytes() if flat else None}
        return _flow_row(tile, ids, code) | {n: [v] for n, v in held.items()}

    return first


def ways_over_flats(start: DataFrame, offsets=EIGHT, size: int = SIZE, most_rounds: int = 10_000) -> DataFrame:
    """``(tr, tc, way)``, written: the ways of ``drained`` of tiles that ``flat_start`` has begun. Rounds carry no ids."""
    names = np.array([EIGHT.index(o) for o in offsets] + [END], np.int8)
    side = size + 2
    done = start.where("level IS NULL").select("tr", "tc", "way")

    def settle(batches):
        for batch in batches:
            for row in batch.to_pylist():
                level = np.frombuffer(row["level"], np.int32).reshape(side, side)
                z = np.frombuffer(row["z"]).reshape(side, side)
                open_ = np.zeros((side, side), bool)
                open_[1:-1, 1:-1] = np.frombuffer(row["way"], np.int8).reshape(size, size) == OPEN
                before = level
                if row["news"]:
                    level = level.copy()
                    for f in row["news"]:
                        level[f["r"] - row["tr"] * size + 1, f["c"] - row["tc"] * size + 1] = f["level"]
                elif row["news"] is None and not row["fresh"]:
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("tr", "tc", "way", "z", "level")} | {"told": []}], layout)
                    continue
                level = spread(level, z, open_, offsets)
                own = np.zeros((side, side), bool)
                own[[1, -2], 1:-1] = own[1:-1, [1, -2]] = True
                told = [{"r": r + row["tr"] * size - 1, "c": c + row["tc"] * size - 1, "level": int(level[r, c])} for r, c in np.argwhere(own & (level < before)).tolist()]
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("tr", "tc", "way", "z")} | {"level": level.tobytes(), "told": told}], layout)

    cell = pa.struct([("r", pa.int64()), ("c", pa.int64()), ("level", pa.int32())])
    layout = pa.schema([("tr", pa.int64()), ("tc", pa.int64()), *((n, pa.binary()) for n in ("way", "z", "level")), ("told", pa.list_(cell))])
    kind = "array<struct<r:long,c:long,level:int>>"
    last, now = None, start.where("level IS NOT NULL").select("tr", "tc", "way", "z", "level", F.lit(None).cast(kind).alias("news"), F.lit(True).alias("fresh"))
    for _ in range(most_rounds):
        settled = kept(now.mapInArrow(settle, f"tr long, tc long, way binary, z binary, level binary, told {kind}"))
        for table in last or ():
            forget(table)
        reach = lambda c: F.sequence(F.floor((F.col(c) - 1) / size), F.floor((F.col(c) + 1) / size))
        told = settled.select("tr", "tc", F.explode("told").alias("f"))
        sent = told.select("f", F.col("tr").alias("of_r"), F.col("tc").alias("of_c"), F.explode(reach("f.r")).alias("tr")).withColumn("tc", F.explode(reach("f.c")))
        news = kept(sent.where("tr <> of_r OR tc <> of_c").groupBy("tr", "tc").agg(F.collect_list("f").alias("news")))
        if not news.limit(1).count():
            forget(news)
            break
        last, now = (settled, news), settled.drop("told").join(news, ["tr", "tc"], "left").withColumn("fresh", F.lit(False))
    else:
        raise RuntimeError("flats did not settle")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                level = np.frombuffer(row["level"], np.int32).reshape(side, side)
                z = np.frombuffer(row["z"]).reshape(side, side)
                way = np.frombuffer(row["way"], np.int8).reshape(size, size).copy()
                open_, found = way == OPEN, np.full((size, size), END, np.int8)
                for (k, _, near), (_, _, height) in zip(reversed(list(steps(level.astype(np.int64), offsets, FAR))), reversed(list(steps(z, offsets, np.nan))), strict=True):
                    fits = ((near == level.astype(np.int64) - 1) & (height == z))[1:-1, 1:-1] & (level[1:-1, 1:-1] < FAR)
                    found[fits] = names[k]
                way[open_] = found[open_]
                yield pa.RecordBatch.from_pylist([{"tr": row["tr"], "tc": row["tc"], "way": way.tobytes()}], pa.schema([("tr", pa.int64()), ("tc", pa.int64()), ("way", pa.binary())]))

    flats = settled.select("tr", "tc", "way", "z", "level").mapInArrow(finish, "tr long, tc long, way binary")
    ways = kept(done.unionByName(flats))
    forget(settled)
    return ways


def relief(cells: DataFrame, value: str = "z", surface: str = "filled", cell_size: float = 1.0, offsets=EIGHT, across: bool = True, size: int = SIZE) -> DataFrame:
    """``(cid, r, c, z, filled, cells_up, slope)`` of a surface and the elevation below it: what drains through each cell, and its slope, 0 without a way down.

    Ways lead across flats (``drained``), or else by steepest descent alone. Cells are shuffled to their tiles once; a tile holds its elevation, its surface and the surface's
    halo, so that slopes, ways and sums meet as tiles, and rows of cells are made once, at the end.
    """
    kinds, side = {n: cells.schema[o].dataType for n, o in {"cid": "cid", "r": "r", "c": "c", "z": value, "filled": surface}.items()}, size + 2
    start = kept(on_tiles(cells, list(dict.fromkeys((surface, value))), flat_start(surface, value, offsets, size), START, 2, size))
    if across:
        ways = ways_over_flats(start, offsets, size)
    else:  # open cells are ends as others are
        ways = kept(start.select("tr", "tc", "way").mapInArrow(closed_ways, "tr long, tc long, way binary"))

    def back(batches):
        for batch in batches:
            for row in batch.to_pylist():
                total, there = refilled(row, size)
                full = np.frombuffer(row["z"]).reshape(side, side)
                drop = steepest(full, offsets)[1][1:-1, 1:-1].ravel()
                own = np.ascontiguousarray(full[1:-1, 1:-1]).ravel()
                z = (own.view(np.int64) ^ np.frombuffer(row["raw"], np.int64)).view(np.float64)
                r, c = np.divmod(np.arange(size * size), size)
                columns = (unpacked(row["ids"]), r + row["tr"] * size, c + row["tc"] * size, z, own, total, drop / cell_size)
                yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in columns], names=["cid", "r", "c", "z", "filled", "cells_up", "slope"])

    met = start.select("tr", "tc", "ids", "z", "raw").join(ways.join(inflows(ways, size), ["tr", "tc"], "left"), ["tr", "tc"])
    rows = met.select("tr", "tc", "ids", "z", "raw", "way", "flows").mapInArrow(back, "cid long, r long, c long, z double, filled double, cells_up long, slope double")
    return rows.withColumns({n: F.col(n).cast(kind) for n, kind in kinds.items()})


def closed_ways(batches):
    for batch in batches:
        for row in batch.to_pylist():
            way = np.frombuffer(row["way"], np.int8)
            row["way"] = np.where(way == OPEN, END, way).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_pylist([row], batch.schema)


def flooded(z: np.ndarray, ids: np.ndarray, own: np.ndarray, out: np.ndarray, rim: np.ndarray) -> tuple[list, list, dict]:
    """Level and basin of an array's ``own`` cells, flooded from low to high, and the lowest passes between basins.

    Water comes in at cells of the edge (``out``, basin ``OUT``) and at those of the rim, which name a basin if no lower one has come to them before.
    The array's outermost cells are never own.
    """
    width = z.shape[1]
    height, name = z.ravel().tolist(), ids.ravel().tolist()
    basin = np.where(own.ravel(), None, False).tolist()  # False: no cell here
    level, done, passes = list(height), [False] * len(height), {}
    for i in np.flatnonzero(out.ravel()).tolist():
        basin[i] = OUT
    front = [(height[i], i) for i in np.flatnonzero((out | rim).ravel()).tolist()]
    heapq.heapify(front)
    ways = [dr * width + dc for dr, dc in EIGHT]
    while front:
        h, i = heapq.heappop(front)
        if done[i]:
            continue
        done[i] = True
        mine = basin[i]
        if mine is None:
            mine = basin[i] = name[i]
        for way in ways:
            j = i + way
            other = basin[j]
            if other is False:
                continue
            if other is None:
                basin[j], level[j] = mine, max(h, height[j])
                heapq.heappush(front, (level[j], j))
            elif other != mine:
                ends, over = (min(mine, other), max(mine, other)), max(h, level[j])
                if over < passes.get(ends, np.inf):
                    passes[ends] = over
    return level, basin, passes


def filled(cells: DataFrame, value: str = "z", size: int = SIZE) -> DataFrame:
    """``(cid, r, c, z, filled)``: sinks raised to the level at which they spill to an edge of the valid cells.

    Each tile is flooded once, from the edge and from its border cells; a basin is named by the border cell where its water came in. How high
    the basins stand follows from the passes between them, in tiles and over borders (``grid.spill_levels``): rounds are over basins of border
    cells, not over cells, which are shuffled once to their tiles and once with their levels. Every valid region has an edge.
    """
    kinds = {n: cells.schema[n].dataType for n in ("cid", "r", "c")}
    valid = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select("cid", "r", "c", F.col(value).alias("z"))

    def work(tile: Tile) -> dict:
        z = tile.bands["z"]
        there = ~np.isnan(z)
        own, border = np.zeros(z.shape, bool), np.zeros(z.shape, bool)
        tile.own(own)[:] = tile.own(there)
        border[[1, -2], 1:-1] = border[1:-1, [1, -2]] = True
        n = sum(near.astype(int) for _, _, near in steps(there, EIGHT, False))
        out = own & (n < 8)
        level, basin, passes = flooded(z, tile.ids, own, out, own & border)
        at = np.flatnonzero(own.ravel())
        names, label = np.unique(np.array([basin[i] for i in at.tolist()], np.int64), return_inverse=True)
        r, c = at // z.shape[1] + tile.tr * size - 1, at % z.shape[1] + tile.tc * size - 1
        edge = np.flatnonzero((own & border).ravel()[at])
        rim = [{"r": a, "c": b, "basin": k, "z": v} for a, b, k, v in zip(r[edge].tolist(), c[edge].tolist(), names[label[edge]].tolist(), z.ravel()[at][edge].tolist(), strict=True)]
        return {
            "tr": [tile.tr], "tc": [tile.tc], "r": [r.astype(np.int64).tobytes()], "c": [c.astype(np.int64).tobytes()], "ids": [packed(tile.ids.ravel()[at])], "z": [z.ravel()[at].tobytes()],
            "level": [unlike(np.array(level, np.float64)[at], z.ravel()[at]).tobytes()], "label": [label.astype(np.int32).tobytes()], "names": [names.tolist()],
            "links": [[{"a": a, "b": b, "pass": v} for (a, b), v in passes.items()]], "rim": [rim],
        }

    held = "tr long, tc long, r binary, c binary, ids binary, z binary, level binary, label binary, names array<long>"
    state = kept(on_tiles(valid, ["z"], work, f"{held}, links array<struct<a:long,b:long,pass:double>>, rim array<struct<r:long,c:long,basin:long,z:double>>", 1, size))
    rim = kept(state.select("tr", "tc", F.explode("rim").alias("x")).select("tr", "tc", "x.*"))
    offsets = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in EIGHT])).alias("o")
    looks = rim.select("tr", "tc", F.col("basin").alias("a"), F.col("z").alias("za"), "r", "c", offsets).withColumns({"r": F.col("r") + F.col("o.dr"), "c": F.col("c") + F.col("o.dc")})
    looks = looks.where((F.floor(F.col("r") / size) != F.col("tr")) | (F.floor(F.col("c") / size) != F.col("tc"))).select("r", "c", "a", "za")
    over = looks.join(rim.select("r", "c", F.col("basin").alias("b"), "z"), ["r", "c"]).where("a <> b").select("a", "b", F.greatest("za", "z").alias("pass"))
    within = state.select(F.explode("links").alias("x")).select("x.*")
    links = over.unionByName(within).unionByName(within.select(F.col("b").alias("a"), F.col("a").alias("b"), "pass"))
    passes = kept(links.groupBy(F.col("a").alias("basin"), F.col("b").alias("other")).agg(F.min("pass").alias("pass")))
    named = kept(state.select("tr", "tc", F.explode("names").alias("basin")))
    levels = spill_levels(named.select("basin").distinct(), passes)
    own = named.join(levels.select("basin", "level"), "basin").groupBy("tr", "tc").agg(F.collect_list(F.struct("basin", "level")).alias("levels"))  # at most one for each border cell of a tile
    forget(rim)

    def back(batches):
        for batch in batches:
            for row in batch.to_pylist():
                level_of = {x["basin"]: x["level"] for x in row["levels"]}
                spill = np.array([level_of[n] for n in row["names"]])
                of = lambda n, kind=np.int64: np.frombuffer(row[n], kind)  # noqa: B023, E731
                z = of("z", np.float64)
                full = np.maximum((of("level") ^ z.view(np.int64)).view(np.float64), spill[of("label", np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unpacked(row["ids"]), of("r"), of("c"), z, full)], names=["cid", "r", "c", "z", "filled"])

    rows = state.drop("links", "rim").join(own, ["tr", "tc"]).select("r", "c", "ids", "z", "level", "label", "names", "levels").mapInArrow(back, "cid long, r long, c long, z double, filled double")
    return rows.withColumns({n: F.col(n).cast(kind) for n, kind in kinds.items() if kind.simpleString() != "bigint"})


def followed(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sides that follow one another (-1: the way leaves): where each one's way ends, the steps to there, and the smallest id on it.

    On a closed way the smallest id is that of the ring, and the steps are those to its side.
    """
    rounds = range(max(1, len(ids)).bit_length() + 1)

    def doubled(ptr, low):
        ahead = (ptr != np.arange(len(ptr))).astype(np.int64)
        for _ in rounds:
            low = np.minimum(low, low[ptr])
            ahead, ptr = ahead + np.where(ptr == np.arange(len(ptr)), 0, ahead[ptr]), ptr[ptr]
        return ptr, ahead, low

    ptr, ahead, low = doubled(np.where(after < 0, np.arange(len(ids)), after), ids)
    closed = after[ptr] >= 0
    if closed.any():
        stop = (after < 0) | (closed & (ids == low))
        again, to, _ = doubled(np.where(stop, np.arange(len(ids)), after), ids)
        ptr, ahead = np.where(closed, again, ptr), np.where(closed, to, ahead)
    return ptr, ahead, low


CLOSED, OPENED, CHAIN = 0, 1, 2
TRACED = ["kind", "component", "x", "y", "a", "d", "head", "low", "low_d", "length", "to"]


def outline_points(parts: DataFrame, most_rounds: int = 64, size: int = SIZE) -> DataFrame:
    """``grid.outline_points`` by tiles: cells are shuffled once; a ring that leaves its tile is a chain in each tile that it passes, and rounds are over chains."""
    walk_ = [(0, 1), (1, 0), (0, -1), (-1, 0)]  # rows and columns of the way along each of ``SIDES``

    def work(tile: Tile) -> dict:
        own, near = tile.own(tile.ids), lambda *at: tile.own(tile.ids, *at)
        r, c = np.indices(own.shape)
        shape = (size, size, 4)
        opened, turned, to_r, to_c, to_k = np.zeros(shape, bool), np.zeros(shape, bool), *(np.zeros(shape, np.int64) for _ in range(3))
        for k, ((dr, dc), side) in enumerate(zip(walk_, SIDES, strict=True)):
            er, ec = side[4:]
            opened[..., k] = (own >= 0) & (near(er, ec) != own)
            ahead, beyond = near(dr, dc) == own, near(dr + er, dc + ec) == own
            left, straight = ahead & beyond, ahead & ~beyond
            to_r[..., k], to_c[..., k] = r + dr * ahead + er * left, c + dc * ahead + ec * left
            to_k[..., k] = (k + np.where(left, -1, np.where(straight, 0, 1))) % 4
            turned[..., k] = ~((near(-dr, -dc) == own) & (near(er - dr, ec - dc) != own))
        on = np.flatnonzero(opened.ravel())
        corner = np.array([side[:2] for side in SIDES])
        start = lambda r, c, k: (c + tile.tc * size + corner[k, 0], r + tile.tr * size + corner[k, 1])
        name = lambda x, y, k: (y * (1 << 32) + x) * 4 + k
        k = on % 4
        x, y = start(on // 4 // size, on // 4 % size, k)
        ids = name(x, y, k)
        nr, nc, nk = (a.ravel()[on] for a in (to_r, to_c, to_k))
        inner = (nr >= 0) & (nr < size) & (nc >= 0) & (nc < size)
        place = np.full(size * size * 4, -1)
        place[on] = np.arange(len(on))
        after = np.full(len(on), -1)
        after[inner] = place[((nr * size + nc) * 4 + nk)[inner]]
        end, ahead, low = followed(ids, after)
        closed = after[end] >= 0
        led = np.zeros(len(on), bool)
        led[after[inner]] = True
        head = np.flatnonzero(~closed & ~led)  # one for each chain
        tail = end[head]
        order = np.argsort(ids)
        least = order[np.searchsorted(ids, low[head], sorter=order)]
        corners = np.flatnonzero(turned.ravel()[on])
        shut = closed[corners]
        none = np.zeros(len(corners), np.int64)
        points = [np.where(shut, CLOSED, OPENED), own.ravel()[on // 4][corners], x[corners], y[corners], np.where(shut, low[corners], ids[end[corners]]), ahead[corners], *[none] * 5]
        zero = np.zeros(len(head), np.int64)
        chains = [zero + CHAIN, zero, zero, zero, ids[tail], zero, ids[head], low[head], ahead[least], ahead[head] + 1, name(*start(nr[tail], nc[tail], nk[tail]), nk[tail])]
        return {n: np.concatenate([p, q]).astype(np.int64) for n, p, q in zip(TRACED, points, chains, strict=True)}

    traced = kept(on_tiles(parts.select(F.col("component").cast("long").alias("cid"), "r", "c"), [], work, ", ".join(f"{n} long" for n in TRACED), 1, size))
    chains = traced.where(F.col("kind") == CHAIN)
    follow = kept(chains.select(F.col("a").alias("id"), "low", "low_d", "length", F.col("to").alias("head")).join(chains.select("head", F.col("a").alias("ptr")), "head").drop("head"))
    state = kept(follow.select("id", "ptr", "low"))
    for _ in range(most_rounds):
        jump = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("beyond"))
        new = kept(state.join(jump, "ptr").select("id", F.col("far").alias("ptr"), F.least("low", "beyond").alias("low"), (F.col("beyond") < F.col("low")).alias("moved")))
        forget(state)
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("rings did not settle")
    known = kept(follow.withColumnRenamed("low", "least").join(state.select("id", F.col("low").alias("ring")), "id"))
    mine = F.col("least") == F.col("ring")  # the chain that holds the ring's first side ends the way
    walk = kept(known.select("id", F.when(mine, F.col("id")).otherwise(F.col("ptr")).alias("ptr"), F.when(mine, F.lit(0).cast("long")).otherwise(F.col("length")).alias("ahead")))
    for _ in range(most_rounds):
        jump = walk.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("ahead").alias("more"))
        new = kept(walk.join(jump, "ptr").select("id", F.col("far").alias("ptr"), (F.col("ahead") + F.when(F.col("ptr") == F.col("id"), 0).otherwise(F.col("more"))).alias("ahead"), (F.col("far") != F.col("ptr")).alias("moved")))
        forget(walk)
        walk = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("rings did not settle")
    rest = known.where(mine).select(F.col("id").alias("ptr"), (F.col("length") - 1 - F.col("low_d")).alias("rest"))
    reach = walk.join(rest, "ptr").select(F.col("id").alias("ptr"), (F.col("ahead") + F.col("rest") + 1).alias("more"))
    placed = kept(known.join(reach, "ptr").select(F.col("id").alias("a"), "ring", "more", F.when(mine, F.col("low_d")).alias("mark")))
    point = ["component", "ring", "seq", "x", "y"]
    whole = traced.where(F.col("kind") == CLOSED).select("component", F.col("a").alias("ring"), (-F.col("d")).alias("seq"), "x", "y")
    steps_ = F.when(F.col("d") >= F.col("mark"), F.col("d") - F.col("mark")).otherwise(F.col("d") + F.col("more"))
    return whole.unionByName(traced.where(F.col("kind") == OPENED).select("component", "a", "d", "x", "y").join(placed, "a").select("component", "ring", (-steps_).alias("seq"), "x", "y")).select(*point)
