"""Many random forests grown together: a pass over the counted rows opens nodes of all settings, folds and trees at once."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import uniform
from .ranks import numbered, quantiles
from .shared import forget, kept

#: Shares of a Poisson draw of mean 1 at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
SUBSETS = {"sqrt": lambda n: max(1, int(math.sqrt(n))), "log2": lambda n: max(1, int(math.log2(n))), "all": lambda n: n}
SUMS = "slot long, feature int, bin int, m long, n0 long, n1 long"


@dataclass(frozen=True)
class Setting:
    """A forest's setting; those that differ in ``trees`` alone share their first trees.

    ``split`` and ``leaf`` are the fewest rows of a node that is split and of
    its parts, counted without repeats. ``classes`` is ``balanced``, weights
    by the sizes of the classes in training rows, or ``balanced_subsample``, in each tree's sample.
    """

    trees: int = 100
    depth: int = 30
    split: int = 2
    leaf: int = 1
    subset: str = "sqrt"
    classes: str = "balanced"

    def __post_init__(self):
        if self.trees < 1 or self.depth < 0 or self.leaf < 1 or self.subset not in SUBSETS or self.classes not in ("balanced", "balanced_subsample"):
            raise ValueError(f"not a forest's setting: {self}")

    def family(self) -> tuple:
        return self.depth, self.split, self.leaf, self.subset, self.classes


@dataclass
class Tree:
    """A tree as lists by node: ``feature`` is -1 at leaves, ``share`` the weighted share of class 1."""

    family: tuple
    fold: int
    number: int
    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    share: list[float] = field(default_factory=lambda: [0.5])
    weights: tuple[float, float] | None = None

    def share_of(self, n0: int, n1: int) -> float:
        noughts, ones = n0 * self.weights[0], n1 * self.weights[1]
        return ones / (ones + noughts)

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.at, self.left, self.right))


def times_drawn(row_hash: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample holds each row: Poisson draws of mean 1, of the row's hash, the tree's number and the seed."""
    start = int.from_bytes(hashlib.md5(f"{seed}:{tree}".encode()).digest()[:8], "little")
    with np.errstate(over="ignore"):
        x = row_hash.astype(np.int64).view(np.uint64) ^ np.uint64(start)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right")


def nodes_of(arrays, bins: np.ndarray) -> np.ndarray:
    """The node of a tree that each row has come to."""
    feature, at, left, right = arrays
    node, every = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, np.where(bins[every, f] <= at[node], left[node], right[node]), node)


def binned(rows: DataFrame, label: str, features: list[str], key: str, folds: int, bins: int = 32, seed: int = 42) -> tuple[DataFrame, dict[str, list[float]]]:
    """``(h, y, fold, x)`` of complete rows, ``x`` the features' bins, and the features' cuts: a bin ends at its cut.

    Rows are put in order by class and draw, and dealt out to folds in turn.
    """
    whole = kept(rows.dropna(subset=[label, *features]).select(*dict.fromkeys([key, label, *features])))
    cuts = {f: sorted({r.cut for r in quantiles(whole, f, [k / bins for k in range(1, bins)]).collect()}) for f in features}  # at most ``bins`` numbers each
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]).cast("array<double>"), lambda c: c < F.col(f))).cast("byte")
    named = whole.select(F.col(key).alias("k"), F.xxhash64(key).alias("h"), F.col(label).cast("byte").alias("y"), F.array(*[bin_of(f) for f in features]).alias("x"))
    placed = numbered(named.withColumn("u", uniform(seed, "fold", "k")), ["y", "u", "k"], "place")
    forget(whole)
    return placed.select("h", "y", (F.col("place") % folds).cast("byte").alias("fold"), "x"), cuts


#: Groups of like rows: what a task of a pass reads at least, and what a task holds at most while it counts them.
READ, HELD = 8192, 65536


def counted(data: DataFrame, n_features: int, numbers: int, seed: int = 42) -> DataFrame:
    """``(x0, x1, .., y, fold, n, m, w)`` of ``binned`` rows: those of equal bins, class and fold as one row, written.

    ``n`` is how many they are; ``m`` and ``w`` say for each of the first ``numbers`` trees how many of them its sample holds, and how
    often in all. A tree looks at bins alone, so passes over these groups give the sums that passes over the rows gave: there are at
    most ``bins ** n_features`` groups for each class and fold, however many rows there are, and never more than rows. A group that a task
    meets again after it gave its groups away is in two parts, which is the same to a pass.
    """
    keys = [f"x{f}" for f in range(n_features)] + ["y", "fold"]
    sums = [f"{c}{t}" for c in "mw" for t in range(numbers)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def given(held: pd.DataFrame) -> pd.DataFrame:
            return held[[*keys, "n"]].assign(**{c: held[[f"{c}{t}" for t in range(numbers)]].to_numpy().tolist() for c in "mw"})

        held = None
        for batch in batches:
            h = batch.pop("h").to_numpy()
            draws = {t: times_drawn(h, t, seed) for t in range(numbers)}
            fresh = pd.concat([batch[keys], pd.DataFrame({"n": np.ones(len(h), np.int64)} | {f"m{t}": (w > 0).astype(np.int64) for t, w in draws.items()} | {f"w{t}": w.astype(np.int64) for t, w in draws.items()})], axis=1)
            held = (fresh if held is None else pd.concat([held, fresh])).groupby(keys, sort=False, as_index=False)[["n", *sums]].sum()
            if len(held) > HELD:
                yield given(held)
                held = None
        if held is not None:
            yield given(held)

    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins_of = [F.get("x", F.lit(f)).alias(f"x{f}") for f in range(n_features)]
    schema = ", ".join(f"x{f} byte" for f in range(n_features)) + ", y byte, fold byte, n long, m array<long>, w array<long>"
    groups = kept(data.select("h", F.col("y").cast("byte").alias("y"), F.col("fold").cast("byte").alias("fold"), *bins_of).repartition(tasks, *keys[:n_features]).mapInPandas(add, schema))
    # near bins to one task: it meets few nodes
    out = kept(groups.repartitionByRange(max(1, min(tasks, groups.count() // READ)), *keys[:n_features]))
    forget(groups)
    return out


def _of_batch(batch: pd.DataFrame, n_features: int) -> tuple[np.ndarray, ...]:
    """Bins of a batch of groups, the different ones and each group's place among them, and its class and fold."""
    x = batch[[f"x{f}" for f in range(n_features)]].to_numpy().astype(np.int64)
    apart, place = np.unique(x, axis=0, return_inverse=True)
    return x, apart, place.ravel(), batch["y"].to_numpy().astype(np.int64), batch["fold"].to_numpy()


def _sums(trees: list, n_features: int, bins: int, n_slots: int):
    """A task's counts by slot, feature and bin, gathered over its batches of groups: rows, and draws of each class."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((3, n_slots * n_features * bins), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, apart, place, y, fold = _of_batch(batch, n_features)
            m, w = (np.stack(batch[c].to_numpy()) for c in "mw")
            for number, left_out, arrays, slots in trees.value:
                slot = slots[nodes_of(arrays, apart)][place]
                met = np.flatnonzero((slot >= 0) & (m[:, number] > 0) & (fold != left_out))
                first, rows, each = slot[met] * n_features, m[met, number], w[met, number]
                ones = each * y[met]
                for f in range(n_features):
                    at = (first + f) * bins + x[met, f]
                    np.add.at(out[0], at, rows)
                    np.add.at(out[1], at, each - ones)
                    np.add.at(out[2], at, ones)
        at = np.flatnonzero(out[0])
        yield pd.DataFrame({"slot": at // (n_features * bins), "feature": (at // bins % n_features).astype("int32"), "bin": (at % bins).astype("int32"), "m": out[0][at], "n0": out[1][at], "n1": out[2][at]})

    return add


def _best(sums: DataFrame, open_: DataFrame) -> DataFrame:
    """A row for each slot: its counts, and its best split, null if there is none.

    Features come in the order of a hash of tree, node and feature; of those that can be split, the first ``k`` are
    weighed by the fall of Gini impurity. Of equal falls the first feature and bin count.
    """
    total = sums.groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("m", "n0", "n1")])
    row = Window.partitionBy("slot", "feature")
    so_far = row.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    each = total.join(F.broadcast(open_), "slot").withColumns({f"l_{c}": F.sum(c).over(so_far) for c in ("m", "n0", "n1")} | {f"t_{c}": F.sum(c).over(row) for c in ("m", "n0", "n1")})
    w0, w1 = F.col("w0"), F.col("w1")  # null at roots weighed by their own sample
    half = F.col("t_n0") + F.col("t_n1")
    w0, w1 = F.coalesce(w0, F.try_divide(half, 2.0 * F.col("t_n0")), F.lit(1.0)), F.coalesce(w1, F.try_divide(half, 2.0 * F.col("t_n1")), F.lit(1.0))
    purity = lambda n0, n1: F.try_divide((n0 * w0) ** 2 + (n1 * w1) ** 2, n0 * w0 + n1 * w1)
    r0, r1 = F.col("t_n0") - F.col("l_n0"), F.col("t_n1") - F.col("l_n1")
    gain = F.round(purity(F.col("l_n0"), F.col("l_n1")) + purity(r0, r1) - purity(F.col("t_n0"), F.col("t_n1")), 9)
    can = F.col("deeper") & (F.col("t_m") >= F.col("split")) & (F.col("l_m") >= F.col("leaf")) & (F.col("t_m") - F.col("l_m") >= F.greatest(F.col("leaf"), F.lit(1))) & (F.col("t_n0") > 0) & (F.col("t_n1") > 0)
    found = F.when(can, F.struct((-gain).alias("fall"), "feature", "bin", "l_m", "l_n0", "l_n1"))
    by_feature = each.groupBy("slot", "feature", "k").agg(F.min(found).alias("found"), F.first("name").alias("name"), *[F.first(f"t_{c}").alias(c) for c in ("m", "n0", "n1")])
    order = Window.partitionBy("slot").orderBy(F.col("found").isNull(), F.md5(F.concat_ws(":", "name", "feature")))
    chosen = by_feature.withColumn("turn", F.row_number().over(order))
    return chosen.groupBy("slot").agg(F.min(F.when(F.col("turn") <= F.col("k"), F.col("found"))).alias("found"), *[F.first(c).alias(c) for c in ("m", "n0", "n1")])


def grown(data: DataFrame, n_features: int, wanted: dict[tuple[tuple, int], int], bins: int = 32, seed: int = 42, at_once: int = 8192) -> list[Tree]:
    """Trees of ``binned`` rows: of each ``(family, fold)`` as many as wanted, fitted on the rows of all other folds (of all rows for fold -1)."""
    groups = counted(data, n_features, max(wanted.values()), seed)
    trees = grown_on(groups, n_features, wanted, bins, seed, at_once)
    forget(groups)
    return trees


def grown_on(groups: DataFrame, n_features: int, wanted: dict[tuple[tuple, int], int], bins: int = 32, seed: int = 42, at_once: int = 8192) -> list[Tree]:
    """``grown`` on the groups of ``counted``.

    A pass over the groups opens up to ``at_once`` nodes of any trees; the others
    wait. A task's counts take ``at_once * n_features * bins`` numbers of 8
    bytes, three times. Groups stay where they are: only counts are shuffled, and
    a pass sends one row for each open node to the driver, where the trees are.
    What a split's parts hold is known with it, so parts that can't be split are opened in no pass.
    """
    spark = groups.sparkSession
    sizes = {(r.fold, r.y): r.n for r in groups.groupBy("fold", "y").agg(F.sum("n").alias("n")).collect()}  # two rows a fold
    if {y for _, y in sizes} != {0, 1}:
        raise ValueError("training rows need both classes")
    trees = [Tree(family, fold, number) for (family, fold), n in wanted.items() for number in range(n)]
    for tree in trees:
        if tree.family[4] == "balanced":
            n = [sum(v for (f, y), v in sizes.items() if y == c and f != tree.fold) for c in (0, 1)]
            tree.weights = tuple(sum(n) / (2 * k) if k else 1.0 for k in n)
    waiting = deque((tree, 0) for tree in trees)
    while waiting:
        now = [waiting.popleft() for _ in range(min(at_once, len(waiting)))]
        slots: dict[int, np.ndarray] = {}
        lines, held = [], {id(tree): tree for tree, _ in now}
        for slot, (tree, node) in enumerate(now):
            slots.setdefault(id(tree), np.full(len(tree.feature), -1, dtype=np.int64))[node] = slot
            w0, w1 = tree.weights or (None, None)
            lines.append((slot, f"{seed}:{tree.number}:{node}", SUBSETS[tree.family[3]](n_features), tree.depth[node] < tree.family[0], tree.family[1], tree.family[2], w0, w1))
        open_ = spark.createDataFrame(lines, "slot long, name string, k int, deeper boolean, split long, leaf long, w0 double, w1 double")
        sent = spark.sparkContext.broadcast([(tree.number, tree.fold, tree.arrays(), slots[key]) for key, tree in held.items()])
        best = _best(groups.mapInPandas(_sums(sent, n_features, bins, len(now)), SUMS), open_)
        for row in best.collect():  # at most ``at_once`` rows
            tree, node = now[row.slot]
            if tree.weights is None:
                tree.weights = tuple((row.n0 + row.n1) / (2 * k) if k else 1.0 for k in (row.n0, row.n1))
            tree.share[node] = tree.share_of(row.n0, row.n1)
            if row.found is None:
                continue
            tree.feature[node], tree.at[node] = row.found.feature, row.found.bin
            part = row.found.l_m, row.found.l_n0, row.found.l_n1
            for side, (m, n0, n1) in ((tree.left, part), (tree.right, (row.m - part[0], row.n0 - part[1], row.n1 - part[2]))):
                side[node] = len(tree.feature)
                for values, v in ((tree.feature, -1), (tree.at, 0), (tree.left, 0), (tree.right, 0), (tree.depth, tree.depth[node] + 1), (tree.share, tree.share_of(n0, n1))):
                    values.append(v)
                if tree.depth[node] + 1 < tree.family[0] and m >= tree.family[1] and n0 and n1:
                    waiting.append((tree, side[node]))
        sent.destroy()
    return trees


def _judged(forests, n_features: int):
    """A task's counts of hits, false alarms and misses of each setting on the rows that its forests left out, group by group."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            _, apart, place, y, fold = _of_batch(batch, n_features)
            n = batch["n"].to_numpy()
            for left_out, sizes, trees in forests.value:
                mine = np.flatnonzero(fold == left_out)
                total, truth = np.zeros(len(apart)), y[mine] == 1
                for number, (arrays, share) in enumerate(trees):
                    total += share[nodes_of(arrays, apart)]
                    said = (total / (number + 1) > 0.5)[place[mine]]
                    for setting in sizes.get(number + 1, ()):
                        out[setting, left_out] = out.get((setting, left_out), 0) + np.array([n[mine][hit].sum() for hit in (said & truth, said & ~truth, ~said & truth)])
        yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["setting", "fold", "hit", "false", "missed"])

    return add


def searched(rows: DataFrame, label: str, features: list[str], key: str, settings: list[Setting], folds: int = 3, seed: int = 42, bins: int = 32, at_once: int = 8192) -> DataFrame:
    """``(rank, mean_score, std_score, trees, depth, split, leaf, subset, classes)``: F1 of class 1 of each setting over stratified folds, best first.

    All forests of all settings and folds grow in the same passes; a setting
    takes the first trees of its family. Equal means share a rank. Rows with a
    null label or feature are left out; a table without both classes is an error.
    """
    data, _ = binned(rows, label, features, key, folds, bins, seed)
    data = counted(data, len(features), max(s.trees for s in settings), seed)
    most: dict[tuple, int] = {}
    for s in settings:
        most[s.family()] = max(s.trees, most.get(s.family(), 0))
    trees = grown_on(data, len(features), {(f, k): n for f, n in most.items() for k in range(folds)}, bins, seed, at_once)
    forests = []
    for (family, fold), each in itertools.groupby(trees, lambda t: (t.family, t.fold)):
        sizes: dict[int, list[int]] = {}
        for i, s in enumerate(settings):
            if s.family() == family:
                sizes.setdefault(s.trees, []).append(i)
        forests.append((fold, sizes, [(t.arrays(), np.array(t.share)) for t in each]))
    sent = rows.sparkSession.sparkContext.broadcast(forests)
    judged = data.mapInPandas(_judged(sent, len(features)), "setting int, fold int, hit long, false long, missed long")
    totals = judged.groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("hit", "false", "missed")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), 2 * F.col("hit") + F.col("false") + F.col("missed")), F.lit(0.0))
    table = kept(totals.groupBy("setting").agg(F.avg(f1).alias("mean_score"), F.stddev_pop(f1).alias("std_score")))
    sent.destroy()
    forget(data)
    named = rows.sparkSession.createDataFrame([(i, s.trees, s.depth, s.split, s.leaf, s.subset, s.classes) for i, s in enumerate(settings)], "setting int, trees int, depth int, split int, leaf int, subset string, classes string")
    rank = F.rank().over(Window.orderBy(F.desc(F.round("mean_score", 12))))  # a row for each setting
    return table.join(F.broadcast(named), "setting").withColumn("rank", rank).orderBy("rank", "setting").select("rank", "mean_score", "std_score", "trees", "depth", "split", "leaf", "subset", "classes")
