"""Mixing, spelling variants and hard negatives against plain versions of the same rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

P = pytest.importorskip("public_tokenizers")
from cellframe.llm import mixing, negatives, spelling  # noqa: E402


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return a in cuts(b) or b in cuts(a)


def plain_variants(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    root = {}
    for w in words:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return sorted((w, form.get(w), root[w], n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def variant_docs(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["straße", "aaaaaa", "aaaaaaa", "aaaaaaaa", "÷×÷×÷×"]
    docs = []
    for doc in range(400):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.12)), len(stems) - 1)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeéÀ") + w[at:], w[:at] + rng.choice("abeé") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize()]))
        docs.append((doc if doc % 50 else None, rng.choice([" ", ", ", "1"]).join(words)))
    docs += [(None, " ".join(["chainaa"] * 250 + ["chainab"] * 50 + ["chainbb"] * 10))]
    return docs + [(7, None), (8, ""), docs[3], docs[3]]


@pytest.mark.parametrize("block", [4096, 7])
def test_variants_equal_plain_search(spark, block):
    docs = variant_docs()
    want = plain_variants(docs)
    assert sum(w[4] > 0 for w in want) > 50 and any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = spelling.variants(table, block=block).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=lambda r: r[0]) == want


def test_a_scan_reuses_rows_and_skips_ranges():
    rng = random.Random(1)
    words = sorted({"abc" + "".join(rng.choice("xyz") for _ in range(rng.randint(3, 4))) for _ in range(150)})
    counts = [(w, rng.randint(1, 9)) for w in words]
    got = {w: (k, n, best) for w, k, n, best in spelling.scan(3, False, counts, counts)}
    for w in words:
        near = [(-n, v) for v, n in counts if one_edit(w, v) and min(len(v), len(w)) // 2 == 3]
        assert got.get(w) == ((len(near), -min(near)[0], min(near)[1]) if near else None)


def plain_mixture(docs, weights, shares, most):
    """Deals the excess again and again, as the rule says it, and picks documents one by one."""
    import hashlib

    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, _, t in docs]
    total = defaultdict(int)
    for (_, s, _), n in zip(docs, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    share = {s: shares[i % len(shares)] for i, s in enumerate(order)}
    target, full = {s: 0.0 for s in order}, set()
    rest = float(sum(total.values()))
    while True:
        live = [s for s in order if s not in full]
        whole = sum(share[s] for s in live)
        left = rest - sum(most * total[s] for s in full)
        target |= {s: left * share[s] / whole for s in live}
        over = {s for s in live if target[s] > most * total[s]}
        if not over:
            break
        full |= over
        target |= {s: float(most * total[s]) for s in over}
    out = []
    for s in order:
        def key(k):
            u = int(hashlib.md5(f"42:mix:{'' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest()[:13], 16) / 2.0**52
            return (-math.log(1 - u) / weights[k], docs[k][0] is not None, docs[k][0] or 0, size[k])

        epochs = int(target[s] // total[s]) if total[s] else 0
        left, before = target[s] - epochs * total[s], 0
        for k in sorted((k for k in range(len(docs)) if docs[k][1] == s), key=key):
            taken = size[k] * (epochs + (2 * before + size[k] <= 2 * left))
            before += size[k]
            out.append((docs[k][0], s, size[k], total[s], target[s], taken))
    return out


def test_mixture_equals_plain_dealing(spark):
    rng = random.Random(5)
    docs = []
    for doc in range(600):
        source = rng.choice(["a"] * 12 + ["b", "c", "d", "ü", "", None, "Z"])
        docs.append((doc, source, rng.choice([None, "", "w " * rng.randint(0, 40), "x y z" * rng.randint(1, 5), "long " * 800 if doc % 97 == 0 else "a\tb\nc"])))
    docs += [docs[5]] * 40 + [(None, "a", "no id here")] * 30 + [(900, "empty", None), (901, "tiny", "one")]
    weights = [1.0 if d[0] is None else [0.5, 1.0, 2.0][d[0] % 3] for d in docs]
    table = spark.createDataFrame([(*d, 0.1, "clash", 3) for d in docs], "doc_id long, source string, text string, weight double, key string, size int")
    known = spark.createDataFrame([(d[0], w) for d, w in set((d[:1], w) for d, w in zip(docs, weights, strict=True)) if d[0] is not None], "doc_id long, weight double")
    got = [(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.mixture(table, known, [5, 2, 1]).collect()]
    want = plain_mixture(docs, weights, [5, 2, 1], 3)
    near = lambda rows: sorted((str(r[0]), str(r[1]), r[2], r[3], round(r[4], 6), r[5]) for r in rows)
    assert near(got) == near(want)
    assert any(r[5] == 3 * r[2] > 0 for r in got) and any(r[5] == 0 and r[2] > 0 for r in got)
    for source in {r[1] for r in got}:
        mine = [r for r in got if r[1] == source]
        assert abs(sum(r[5] for r in mine) - mine[0][4]) <= max(r[2] for r in mine) / 2 + 1e-6
        assert all(r[5] <= 3 * r[2] for r in mine)


SCHEMA = "doc_id long, source string, text string"


def test_weights_draw_better_documents_first(spark):
    rows = [(i, "s" if i < 3000 else "t", "w") for i in range(6000)]
    known = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 1 THEN 4.0D END AS weight").where("weight IS NOT NULL")
    got = mixing.mixture(spark.createDataFrame(rows, SCHEMA), known, [1, 3]).where("source = 's'").collect()
    took = [sum(r.taken for r in got if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert sum(took) == 1500 and took[1] > 1.6 * took[0]


def test_odd_weights_and_empty_table(spark):
    known = spark.createDataFrame([(1, None), (2, -1.0)], "doc_id long, weight double")
    got = mixing.mixture(spark.createDataFrame([(1, "a", "x y"), (2, "a", "x"), (3, None, "x")], SCHEMA), known, [5, 2, 1]).collect()
    assert len(got) == 3 and all(r.taken is not None for r in got)
    assert mixing.mixture(spark.createDataFrame([], SCHEMA), known, [5, 2, 1]).collect() == []


def plain_negatives(rows, every=50):
    def ok(r):
        return r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    rows = [(r[0], [math.floor(256 * x) for x in r[1]], (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r in rows if ok(r)]
    last = lambda v: float("inf") if v is None else v
    out = []
    for i, (a, v, label) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), b, other) for j, (b, w, other) in enumerate(rows) if j != i]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:3]
            out += [(a, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(n=900, dim=8, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for k in range(n):
        centre = rng.choice(centres)
        v = [c + rng.gauss(0, 0.3) for c in centre] if k % 5 else list(centre)
        rows.append((k, v, k % 10 if k % 40 else 3))
    rows += [(None, list(centres[0]), 1), (1000, None, 1), (1001, [None] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] + [0.0] * (dim - 1), 2), (1004, centres[1], None), (1050, [], 2), (1100, centres[2][:3], 3)]
    return rows + [rows[100], rows[100], rows[7]]


@pytest.mark.parametrize("sizes", [(1024, 2048, 16), (5, 37, 2)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("TREE", "ROWS", "TREES"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, tree string, uid int")
    as_float = [(r[0], None if r[1] is None else [None if x is None else float(__import__("numpy").float32(x)) for x in r[1]], r[2]) for r in rows]
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(table).collect()]
    want = plain_negatives(as_float)
    assert len(want) > 100 and sorted(got, key=str) == want


def test_scores_beyond_a_double_stay_whole(spark):
    big = 2.0**40
    rows = [(0, [big, 3.0], 1), (1, [big, 1.0], 1), (2, [big * 0.9, 7.0], 2), (3, [big * 0.9, 9.0], 2), (4, [-big, 0.0], 2)]
    rows = [(i, [x / 2**12 for x in v], label) for i, v, label in rows]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got), key=str) == plain_negatives(rows)


def test_bounds_spare_scores():
    """On clustered rows the tree's bounds leave most rows unscored, and what they leave out is outside the window."""
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (30, 16)).round()
    x = np.repeat(centres, 40, 0) + rng.integers(-2, 3, (1200, 16))
    block = negatives.Block(np.arange(1200).tobytes(), np.arange(1200).tobytes(), np.zeros(1200, int).tobytes(), x.tobytes())
    tree = negatives.Block(np.arange(300).tobytes(), np.arange(300).tobytes(), np.zeros(300, int).tobytes(), x[::4].copy().tobytes())
    parents, edges, order = negatives.spanning_tree(tree.x)
    assert sorted(order) == list(range(300)) and (parents < 0).sum() == 1
    scored = 0
    for slot, rows, scores in negatives.walk(tree, parents, edges, order, block, lambda slot, low, high: high >= 15000):
        scored += len(rows)
        every = block.x @ tree.x[slot]
        assert set(np.flatnonzero(every >= 15000)) <= set(rows) and (scores == every[rows]).all()
    assert scored < 0.5 * 300 * 1200
