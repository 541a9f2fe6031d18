"""Hard negatives of anchors: scores along spanning trees of anchors bound the scores of all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import bounded_batches, shared_dir, written

#: Anchors of one tree, rows of one block, trees that one pass over the rows meets: bounds of what a task and the driver hold.
TREE, ROWS, TREES = 1024, 2048, 16
#: Scores up to here are whole numbers in a double.
EXACT = 2.0**53


def prepared(table: DataFrame, scale: int = 256) -> DataFrame:
    """``(uid, vec_id, label, vector)`` of the rows that take part: components scaled (and floored when packed), labels of every seventh id moved on by one.

    Rows with a null label or vector, or a component that is null or not finite, are left out.
    """
    low = F.filter("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.transform("embedding", lambda x: x.cast("double") * scale)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taken = table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.size(low) == 0)
    return taken.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), vector.alias("vector"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; a shorter vector counts as one with zeros behind it."""
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    if len(vectors) and (np.diff(offsets) == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim))
    for row in range(len(vectors)):
        part = flat[offsets[row] : offsets[row + 1]]
        out[row, : len(part)] = part
    return out


PACKED = "ids binary, uids binary, labels binary, vectors binary"


def _packed(table: pa.Table, dim: int) -> dict:
    column = table.combine_chunks().to_batches()[0]
    ids = np.array([np.iinfo(np.int64).max if v is None else v for v in column["vec_id"].to_pylist()], np.int64)
    return {"ids": ids.tobytes(), "uids": column["uid"].to_numpy().tobytes(), "labels": column["label"].to_numpy().tobytes(), "vectors": np.floor(_matrix(column["vector"], dim)).tobytes()}


def _gathered(batches, most: int):
    """Tables of ``most`` rows, the last one smaller, from batches of any size."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= most:
            held.append(batch.slice(0, most - n))
            yield pa.Table.from_batches(held)
            batch, held, n = batch.slice(most - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning tree by Prim's rule: each row's parent (-1 of the root), its distance, and an order in which branches are walked whole."""
    n = len(x)
    norms = (x * x).sum(1)
    parent, best, done = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)
    at, children = 0, [[] for _ in range(n)]
    for _ in range(n):
        done[at] = True
        far = np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0)
        near = ~done & (far < best)
        best[near], parent[near] = far[near], at
        best[at] = np.inf if parent[at] < 0 else best[at]
        open_ = np.where(done, np.inf, best)
        at = int(open_.argmin())
    edges = np.where(parent >= 0, np.sqrt(((x - x[np.maximum(parent, 0)]) ** 2).sum(1)), 0.0)
    for row in range(n):
        if parent[row] >= 0:
            children[parent[row]].append(row)
    order, stack = [], [0]
    while stack:
        order.append(at := stack.pop())
        stack += children[at]
    return parent.astype(np.int64), edges, np.array(order, np.int64)


def anchor_trees(anchors: DataFrame, dim: int, tree: int = TREE) -> DataFrame:
    """Anchors in sorted lots of at most ``tree``, each with its spanning tree: one row a tree, ``tree`` numbered from 0.

    They are sorted by label and the signs of sums of components, so that those near each other tend to share a tree.
    """
    sums = [F.aggregate(F.slice("vector", 1 + k, 8), F.lit(0.0), lambda s, v: s + v) for k in range(0, min(dim, 64), 8)]
    code = F.concat(*[F.when(s >= 0, F.lit("1")).otherwise(F.lit("0")) for s in sums]) if sums else F.lit("")

    def build(batches):
        for lot in _gathered(batches, tree):
            row = _packed(lot, dim)
            parent, edges, order = spanning_tree(np.frombuffer(row["vectors"]).reshape(-1, dim))
            row |= {"parents": parent.tobytes(), "edges": edges.tobytes(), "walk": order.tobytes(), "first": lot["uid"][0].as_py()}
            yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([(n, pa.binary()) for n in ("ids", "uids", "labels", "vectors", "parents", "edges", "walk")] + [("first", pa.int64())])
    parts = max(1, math.ceil(anchors.count() / tree))
    placed = anchors.withColumn("code", code).repartitionByRange(parts, "label", "code", "uid").sortWithinPartitions("label", "code", "uid").select("uid", "vec_id", "label", "vector")
    built = written(placed.mapInArrow(build, f"{PACKED}, parents binary, edges binary, walk binary, first long"))
    return written(numbered(built, ["first"], "nth").withColumn("tree", F.col("nth") - 1).drop("nth", "first"))


class Block:
    """Rows side by side, as one matrix with norms."""

    def __init__(self, ids: bytes, uids: bytes, labels: bytes, vectors: bytes):
        self.ids, self.uids, self.labels = (np.frombuffer(b, np.int64) for b in (ids, uids, labels))
        self.x = np.frombuffer(vectors).reshape(len(self.ids), -1)
        # a bound on all products and sums of them, so that floating point holds them whole
        top = float(np.abs(self.x).max(initial=0))
        self.whole = top * top * self.x.shape[1] < EXACT / 4
        self.norms = np.sqrt((self.x * self.x).sum(1))

    def score(self, rows, anchor: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.x[rows] @ anchor
        whole = [int(v) for v in anchor]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in self.x[rows]], object)


def walk(tree: Block, parents, edges, order, block: Block, wanted):
    """Goes down the tree. ``wanted(slot, low, high)`` says which rows an anchor has to score, from bounds of all rows' scores; yields ``(slot, rows, scores)``.

    A row's score at a child differs from that at the parent by the edge's length times the row's norm at most. What was
    scored is bounded by itself; bounds of a branch are let go when its last child is done.
    """
    exact = block.whole and tree.whole and float(np.abs(tree.x).max(initial=0)) * float(np.abs(block.x).max(initial=0)) * max(1, tree.x.shape[1]) < EXACT / 4
    left = np.bincount(parents[parents >= 0], minlength=len(parents))
    slack, bounds = 1e-9, {}
    for slot in order.tolist():
        up = int(parents[slot])
        anchor = tree.x[slot]
        if up < 0:
            reach = block.norms * math.sqrt(float(anchor @ anchor)) * (1 + slack)
            low, high = -reach, reach
        else:
            reach = block.norms * (edges[slot] * (1 + slack)) + slack * block.norms
            low, high = bounds[up][0] - reach, bounds[up][1] + reach
            left[up] -= 1
            if not left[up]:
                del bounds[up]
        rows = np.flatnonzero(wanted(slot, low, high))
        scores = block.score(rows, anchor, exact)
        if left[slot]:
            low[rows] = high[rows] = scores.astype(float)
            bounds[slot] = low, high
        yield slot, rows, scores


def best_first(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, of equal ones the smaller id first."""
    if len(scores) > 4 * most and scores.dtype != object:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        inside = np.flatnonzero(scores >= cut)
        return inside[np.lexsort((ids[inside], -scores[inside]))[:most]]
    return np.lexsort((ids, -scores))[:most] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda k: (-scores[k], ids[k]))[:most], int)


LONGEST = 2**63 - 1


def _long(v) -> int:
    """A score as a long; one beyond its range counts as the nearest long."""
    return max(-LONGEST - 1, min(LONGEST, int(v)))


def _merged(old: list, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> list:
    """The best of what was found before and of ``rows`` with their scores, as ``(id, score)``."""
    top = best_first(ids[rows], scores, most)
    return sorted(old + [(int(ids[rows[k]]), _long(scores[k])) for k in top], key=lambda v: (-v[1], v[0]))[:most]


class Positives:
    """For each anchor of a tree its first ``most`` other rows of the same label among the blocks seen so far."""

    def __init__(self, tree: Block, found: list, most: int):
        self.tree, self.most, self.held = tree, most, {}

    def wanted(self, block: Block, slot: int, low, high):
        held = self.held.get((slot, 0), [])
        own = (block.labels == self.tree.labels[slot]) & (block.uids != self.tree.uids[slot])
        return own if len(held) < self.most else own & (high >= held[-1][1])

    def take(self, block: Block, slot: int, rows, scores):
        self.held[slot, 0] = _merged(self.held.get((slot, 0), []), rows, scores, block.ids, self.most)


class Negatives:
    """For each positive of an anchor the first ``most`` rows of other labels in the window of its score."""

    def __init__(self, tree: Block, found: list, most: int, low_share: int, high_share: int):
        self.tree, self.most, self.held, self.windows = tree, most, {}, {}
        for slot, nth, score in found:
            self.windows.setdefault(slot, []).append((nth, -(-low_share * score // 100), high_share * score // 100))

    def open_(self, slot: int):
        """Each positive's window, from where a row would still be among the best so far."""
        for nth, least, top in self.windows.get(slot, ()):
            held = self.held.get((slot, nth), [])
            least = max(least, held[-1][1]) if len(held) == self.most else least
            if least <= top:
                yield nth, least, top

    def wanted(self, block: Block, slot: int, low, high):
        out = np.zeros(len(low), bool)
        for _, least, top in self.open_(slot):
            out |= (high >= least) & (low <= top)
        return out & (block.labels != self.tree.labels[slot])

    def take(self, block: Block, slot: int, rows, scores):
        for nth, least, top in self.open_(slot):
            inside = np.flatnonzero((scores >= least) & (scores <= top))
            if len(inside):
                self.held[slot, nth] = _merged(self.held.get((slot, nth), []), rows[inside], scores[inside], block.ids, self.most)


FOUND = "tree long, slot int, nth int, place int, anchor_id long, id long, score long"


def searched(blocks: DataFrame, trees: DataFrame, kind, found: DataFrame | None = None) -> DataFrame:
    """All blocks against all trees: a pass for each ``TREES`` trees, which are sent to every task; what each task found for an anchor is handed on.

    A pass sends at most ``TREES`` times ``TREE`` vectors through the driver, whatever the input's size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, path = blocks.sparkSession, shared_dir(blocks.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(FOUND))
    for lo in range(0, max(1, trees.count()), TREES):
        lot = F.col("tree").between(lo, lo + TREES - 1)
        known: dict[int, list] = {}
        for row in found.where(lot).select("tree", "slot", "place", "score").collect() if found else []:
            known.setdefault(row[0], []).append(tuple(row[1:]))
        sent = spark.sparkContext.broadcast([(row.asDict(), known.get(row.tree, [])) for row in trees.where(lot).collect()])

        def run(batches, sent=sent):
            each = []
            for row, windows in sent.value:
                tree = Block(*(row[n] for n in ("ids", "uids", "labels", "vectors")))
                each.append((row["tree"], tree, *(np.frombuffer(row[n], t) for n, t in (("parents", np.int64), ("edges", np.float64), ("walk", np.int64))), kind(tree, windows)))
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row["ids"], row["uids"], row["labels"], row["vectors"])
                    for _, tree, parents, edges, order, state in each:
                        for slot, rows, scores in walk(tree, parents, edges, order, block, lambda *at, state=state, block=block: state.wanted(block, *at)):
                            if len(rows):
                                state.take(block, slot, rows, scores)
            rows = [(name, slot, nth, place, int(tree.ids[slot]), *value) for name, tree, _, _, _, state in each for (slot, nth), values in state.held.items() for place, value in enumerate(values)]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000], strict=True), schema, strict=True)], schema=schema)

        blocks.mapInArrow(run, FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(FOUND).parquet(path)


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of what all tasks found for each anchor and positive."""
    order = Window.partitionBy("tree", "slot", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(table: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low_share: int = 50, high_share: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for anchors, the rows whose id is divisible by ``every``.

    An anchor's positives are the first rows of its label, its negatives for one of them the first rows of other labels that score between
    ``low_share`` and ``high_share`` percent of it. Anchors are searched in trees (``anchor_trees``); all rows, in blocks, meet all of
    them, and a row is scored only where bounds from the parent anchor reach the window, which narrows as rows are found. Scores are whole numbers.

    Rows with a null label or vector or a component that isn't finite take no part. A row with a null id is no anchor; as a partner its id is null and
    comes after all others. Of repeated rows each one is a row, also as an anchor. A shorter vector counts as one with zeros behind it. A score beyond
    a long's range counts as the nearest long. An empty table gives an empty result.
    """
    bounded_batches(table.sparkSession)
    rows = written(prepared(table))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(math.ceil(n / ROWS), 4 * cores), math.ceil(n / (16 * ROWS)))
    schema = pa.schema([(c, pa.binary()) for c in ("ids", "uids", "labels", "vectors")])

    def pack(batches):
        for lot in _gathered(batches, ROWS):
            yield pa.RecordBatch.from_pylist([_packed(lot, dim)], schema)

    blocks = written(rows.select("uid", "vec_id", "label", "vector").coalesce(parts).mapInArrow(pack, PACKED))
    trees = anchor_trees(rows.where(F.col("vec_id") % every == 0), dim)
    positives = written(first_of(searched(blocks, trees, lambda tree, found: Positives(tree, found, n_positives)), n_positives))
    found = searched(blocks, trees, lambda tree, found: Negatives(tree, found, n_negatives, low_share, high_share), positives)
    negatives = first_of(found, n_negatives).select("tree", "slot", F.col("nth").alias("place"), F.col("place").alias("rank"), F.col("id").alias("n_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != LONGEST, F.col(c))
    met = negatives.join(positives, ["tree", "slot", "place"])
    return met.select("anchor_id", known("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("n_id").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")


#: DuckDB SQL of ``hard_negatives`` over the given table, by all pairs.
ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * x::double)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::bigint AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM pos JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""
