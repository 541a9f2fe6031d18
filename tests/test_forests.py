"""Forests grown together against trees that are grown one by one in plain Python."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import forests
from cellframe.operators.forests import SUBSETS, Setting

NAMES = ["a", "b", "c"]


def rows_of(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.random(), float(rng.randint(0, 4)), rng.gauss(0, 1)
        rows.append((k, a if k % 50 else None, b, c, int(a + 0.1 * b + 0.2 * c + rng.gauss(0, 0.2) > 0.9)))
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int")


def plain_tree(data, setting, fold, number, seed):
    """A tree as nested tuples: ``(share,)`` or ``(feature, bin, left, right)``; nodes are numbered as they are made."""
    draws = forests.times_drawn(np.array([h for h, *_ in data]), number, seed)
    train = [(x, y, int(w)) for (h, y, f, x), w in zip(data, draws, strict=True) if f != fold and w]
    base = [y for _, y, f, _ in data if f != fold] if setting.classes == "balanced" else [y for _, y, w in train for _ in range(w)]
    weight = {c: len(base) / (2 * base.count(c)) for c in (0, 1)}
    sums = lambda part: [weight[c] * sum(w for _, y, w in part if y == c) for c in (0, 1)]
    pure = lambda part: sum(v * v for v in sums(part)) / sum(sums(part))
    nodes, line = {}, [(0, train, 0)]
    made = 1
    while line:
        node, part, depth = line.pop(0)
        nodes[node] = [sums(part)[1] / sum(sums(part))]
        if depth >= setting.depth or len(part) < setting.split or len({y for _, y, _ in part}) < 2:
            continue
        by_feature = {}
        for f in range(len(NAMES)):
            for b in sorted({x[f] for x, _, _ in part}):
                left, right = [r for r in part if r[0][f] <= b], [r for r in part if r[0][f] > b]
                if min(len(left), len(right)) >= max(1, setting.leaf):
                    by_feature.setdefault(f, []).append((-round(pure(left) + pure(right) - pure(part), 9), f, b))
        order = sorted(by_feature, key=lambda f: hashlib.md5(f"{seed}:{number}:{node}:{f}".encode()).hexdigest())
        found = [s for f in order[: SUBSETS[setting.subset](len(NAMES))] for s in by_feature[f]]
        if found:
            _, f, b = min(found)
            nodes[node] += [f, b, made, made + 1]
            line += [(made, [r for r in part if r[0][f] <= b], depth + 1), (made + 1, [r for r in part if r[0][f] > b], depth + 1)]
            made += 2
    return nodes


def share_of(nodes, x):
    node = 0
    while len(nodes[node]) > 1:
        _, f, b, left, right = nodes[node]
        node = left if x[f] <= b else right
    return nodes[node][0]


SETTINGS = [Setting(3, 4, 2, 1, "all", "balanced"), Setting(2, 4, 2, 1, "all", "balanced"), Setting(2, 3, 10, 4, "sqrt", "balanced_subsample"), Setting(2, 30, 2, 1, "log2", "balanced")]


@pytest.fixture(scope="module")
def data(spark):
    table, cuts = forests.binned(rows_of(spark), "y", NAMES, "k", 3, bins=8, seed=7)
    return [(r.h, r.y, r.fold, list(r.x)) for r in table.collect()], cuts


def test_bins_and_folds(spark, data):
    rows, cuts = data
    assert len(rows) == 235 and len(cuts["a"]) == 7 and len(cuts["b"]) <= 5
    for c in (0, 1):
        sizes = [sum(1 for _, y, f, _ in rows if y == c and f == k) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1
    whole = rows_of(spark).dropna().select(F.xxhash64("k").alias("h"), *NAMES).collect()
    want = {r.h: [sum(c < r[f] for c in cuts[f]) for f in NAMES] for r in whole}
    assert {h: x for h, _, _, x in rows} == want


def test_draws_have_the_mean_and_spread_of_samples():
    w = forests.times_drawn(np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 40000), 3, 1)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01


@pytest.mark.parametrize("at_once", [5000, 7])
def test_trees_against_plain_ones(spark, data, at_once):
    rows, _ = data
    settings = SETTINGS[:1] if at_once < 100 else SETTINGS
    table = spark.createDataFrame(rows, "h long, y byte, fold byte, x array<byte>")
    wanted = {(s.family(), fold): s.trees for s in reversed(settings) for fold in ((0,) if at_once < 100 else (0, 2, -1))}
    for tree in forests.grown(table, 3, wanted, bins=8, seed=7, at_once=at_once):
        setting = next(s for s in settings if s.family() == tree.family)
        want = plain_tree(rows, setting, tree.fold, tree.number, 7)
        assert len(tree.feature) > 3
        for _, _, _, x in rows:
            node = forests.nodes_of(tree.arrays(), np.array([x]))[0]
            assert abs(tree.share[node] - share_of(want, x)) < 1e-12


def test_search_against_plain_forests(spark, data):
    rows, _ = data
    got = {(r.trees, r.depth, r.split, r.subset): r for r in forests.searched(rows_of(spark), "y", NAMES, "k", SETTINGS, 3, 7, bins=8).collect()}
    means = {}
    for s in SETTINGS:
        scores = []
        for fold in range(3):
            trees = [plain_tree(rows, s, fold, t, 7) for t in range(s.trees)]
            said = [(sum(share_of(t, x) for t in trees) / len(trees) > 0.5, y == 1) for _, y, f, x in rows if f == fold]
            hit, wrong = sum(a and b for a, b in said), sum(a != b for a, b in said)
            scores.append(2 * hit / (2 * hit + wrong))
        row = got[s.trees, s.depth, s.split, s.subset]
        means[s] = statistics.fmean(scores)
        assert abs(row.mean_score - means[s]) < 1e-9 and abs(row.std_score - statistics.pstdev(scores)) < 1e-9
        assert row.mean_score > 0.6
    for s in SETTINGS:
        assert got[s.trees, s.depth, s.split, s.subset]["rank"] == 1 + sum(m > means[s] + 1e-12 for m in means.values())


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        forests.searched(rows_of(spark).where("y = 1"), "y", NAMES, "k", SETTINGS[:1])
    with pytest.raises(ValueError):
        Setting(subset="half")
