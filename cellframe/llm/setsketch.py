"""Near duplicates by SetSketch registers: banded candidates, joint likelihood, exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEPT, components, map_batches, sole, written

ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
BASE = 1.2  # registers are whole powers of this base
SHIFT = 20  # so that the largest minimum still has a register over 0
CROWD = 8  # members up to which a bucket's pairs are listed; larger buckets are compared in blocks
BLOCK = 256
SLOTS = 1 << 20  # of the filter before texts are shuffled: 16 MB at most, whatever the corpus; of no use beyond as many texts
_random = np.random.default_rng(20240229)
FACTORS = _random.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIPS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are what white space (U+0020, U+0009 to U+000D) parts, A-Z in lower
    case. With fewer words than a shingle has, the whole sequence is one; with
    none, the set is empty.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    sole(_words)
    if len(_words) > MOST_KEPT:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * PRIME + hashes[k : k + n]
    return np.unique(mixed(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the set's hashes under each register's permutation of 32-bit words."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 128):
        np.minimum(low, ((h[at : at + 128, None] ^ FLIPS) * FACTORS).min(axis=0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """SetSketch registers of minima: exponential variates, spaced by powers of the base, truncated to a byte.

    The register of a union is the larger of two registers.
    """
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + SHIFT, 0, 255).astype(np.uint8)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's number and registers, ``(rows, bands)``; different bands never share one."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = key << np.uint64(8) | parts[:, :, k]
    return mixed(key)


GRID = np.linspace(0.0, 1.0, 101)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, slack: float = 18.0) -> np.ndarray:
    """Whether a similarity of ``least`` or more is plausible by the joint likelihood of both sketches.

    Counts of registers that are larger in one, in the other, and equal have a
    multinomial likelihood in the similarity, given both cardinalities. A pair
    passes if the best likelihood from ``least`` up is within ``slack`` of the
    best of all (18: six standard deviations).
    """
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = GRID[None, :] * most
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    score = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
    near = np.where(j >= least - 0.01, score, -np.inf).max(axis=1)
    return near >= score.max(axis=1) - slack


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, tie, n_shingles, set_hash, regs)`` of each row, written once; ``tie`` is a hash of the text."""

    def run(batch):
        sets = [shingle_set(t, width) for t in batch["text"]]
        regs = registers(np.array([minima(s) for s in sets])) if sets else []
        return {
            "id": batch["id"],
            "tie": batch["tie"],
            "n_shingles": [len(s) for s in sets],
            "set_hash": [hashlib.md5(s.tobytes()).digest() for s in sets],
            "regs": [r.tobytes() if len(s) else b"" for s, r in zip(sets, regs, strict=True)],
        }

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return written(map_batches(rows, run, "id long, tie long, n_shingles long, set_hash binary, regs binary"))


def compared(open_ids, open_comps, open_sets, ids, comps, sets, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets, enough to join what they link; pairs already in one component are left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    flat = np.concatenate([*open_sets, *sets])
    _, codes = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    first = sum(map(len, open_sets))
    starts = first + np.append(0, np.cumsum(sizes)[:-1])
    rest, at, links = codes[first:], 0, []
    has = np.zeros(codes.max() + 1, bool)
    for x, comp, own in zip(open_ids, open_comps, open_sets, strict=True):
        mine = codes[at : at + len(own)]
        at += len(own)
        has[mine] = True
        both = np.add.reduceat(has[rest].astype(np.int64), starts - first)
        has[mine] = False
        for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
            if (p := find(int(comp))) != (q := find(int(comps[k]))):
                root[max(p, q)] = min(p, q)
                links.append((int(x), int(ids[k])))
    return links


def clusters(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tie, n_shingles, component_id, best)`` of each row of ``docs``.

    As ``near_duplicates``; ``tie`` is ``xxhash64`` of the text, and ``best``
    says that no row of the component has a smaller ``(id, tie)``. Only rows
    that are equal in id and text are best together.
    """
    least = percent / 100
    rows = sketched(docs, width, id_col, text_col)
    some = rows.where("id IS NOT NULL AND n_shingles > 0")
    # a node for each different set; its number is fixed by the table that is written here
    reps = some.groupBy("set_hash").agg(F.min(F.struct("id", "tie")).alias("low"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("node"), "set_hash", "low", "n", "regs"))

    def keys(batch):
        regs = np.frombuffer(b"".join(batch["regs"]), np.uint8).reshape(-1, REGISTERS)
        return {"node": batch["node"], "keys": list(band_keys(regs).view(np.int64))}

    # tables that large ones are joined with are written first, so that Spark knows their size and can split hot keys
    bands = map_batches(reps.select("node", "regs"), keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    counts = written(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    crowds = written(bands.join(counts, "key"))

    members = crowds.where(F.col("n") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    listed = members.select(F.explode(F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    hot = crowds.where(F.col("n") > CROWD)
    company = hot.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = written(hot.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("hub")))
    spokes = written(hot.join(hubs, "key").where("node <> hub").select("node", "hub").distinct())
    pairs = listed.unionByName(spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()

    def likely(batch):
        a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        return {"a": batch["a"], "b": batch["b"], "ok": plausible(a, b, np.array(batch["na"], float), np.array(batch["nb"], float), least)}

    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely_pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    candidates = written(map_batches(likely_pairs, likely, "a long, b long, ok boolean").where("ok").select("a", "b"))

    wanted = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).unionByName(spokes.select("node")).unionByName(spokes.select(F.col("hub").alias("node"))).distinct()
    wanted = written(reps.select("node", "low").join(wanted, "node", "left_semi").select("node", "low.*"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    if wanted.count() < SLOTS:  # a coarse filter of fixed size first: few texts are shuffled; beyond that it would let most of them through
        slot = F.pmod(F.xxhash64("id", "tie"), F.lit(SLOTS)).alias("slot")
        texts = texts.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")
    texts = texts.join(wanted, ["id", "tie"]).select("node", "text")
    sets = map_batches(texts, lambda batch: {"node": batch["node"], "shingles": [shingle_set(t, width).view(np.int64) for t in batch["text"]]}, "node long, shingles array<long>")
    sets = written(sets.dropDuplicates(["node"]))
    shared = F.size(F.array_intersect("sa", "sb"))
    checked = candidates.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    links = written(checked.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b").distinct())
    labels = components(links)

    group = spokes.unionByName(spokes.select(F.col("hub").alias("node"), "hub").distinct())
    group = written(group.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "hub", F.coalesce("component", "node").alias("component")))
    main = group.where("node = hub").select("hub", F.col("component").alias("main"))
    sized = group.join(written(main), "hub").groupBy("hub", "main").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("n_open")).where("n_open > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    apart = written(sized.select("hub", "main", blocks("n_open").alias("os"), blocks("n").alias("ms")))
    member = group.join(apart, "hub").join(sets, "node").withColumn("spread", F.abs(F.xxhash64("node", "hub")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: (F.col("spread") % F.col(n)).cast("int")
    own = ["node", "component", "shingles"]
    sides = member.where("component <> main").select("hub", block("os").alias("o"), every("ms").alias("m"), F.lit(0).alias("side"), *own)
    sides = sides.unionByName(member.select("hub", every("os").alias("o"), block("ms").alias("m"), F.lit(1).alias("side"), *own))

    def block_links(table: pa.Table) -> pa.Table:
        split = [table.filter(pc.equal(table["side"], s)) for s in (0, 1)]
        found = []
        if all(t.num_rows for t in split):
            parts = [(t["node"].to_numpy(), t["component"].to_numpy(), [np.asarray(x.values) for x in t["shingles"]]) for t in split]
            found = compared(*parts[0], *parts[1], percent)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    more = written(sides.groupBy("hub", "o", "m").applyInArrow(block_links, "a long, b long"))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = reps.select("node", "set_hash", "low").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    lowest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("lowest"))
    named = written(named.join(lowest, "component", "left").select("set_hash", F.coalesce("lowest", "low").alias("lowest")))
    found = some.join(named, "set_hash").select("id", "tie", "n_shingles", F.col("lowest.id").alias("component_id"), (F.struct("id", "tie") == F.col("lowest")).alias("best"))
    alone = rows.where("id IS NULL OR n_shingles = 0").select("id", "tie", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("best"))
    return found.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Two documents are linked if ``100 * shared >= percent * joint`` of their sets
    of distinct ``width``-word shingles; ``component_id`` is the smallest id that
    can be reached over links, ``kept`` says that it is the row's own.

    Equal sets are one node from the start. Forty bands of six registers bring
    together pairs of similarity 0.8 but for five in a million, and pairs of 0.9
    but for fewer still. A bucket of up to 8 nodes lists its pairs. A larger
    bucket links its members to a hub, the member with the most company over all
    bands; members that this leaves in another component than their hub's are
    then compared with all members that share the hub, in blocks of 256, so
    that no bucket lists all its pairs and none is cut. Pairs that joint
    likelihood leaves plausible are confirmed on the full sets.

    Ids are integers. Rows with a null id, a null or empty text, or no words are
    linked with nothing; their component is their own id. Rows that share an id
    may have different texts; each is linked by its own text. An empty table
    gives an empty result. Other columns aren't read.
    """
    found = clusters(docs, width, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
