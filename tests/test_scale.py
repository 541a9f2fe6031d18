"""Tables that are read again and again are written first, and steps on tiles agree with plain walks."""

import random

import numpy as np
from pyspark.sql import functions as F

from cellframe.functions import sampling as S
from cellframe.operators import features, forests, grid, tiles
from cellframe.plans import jobs
from cellframe.plans.config import job_settings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_graph_model_reads_a_written_table(spark):
    """A fit makes hundreds of passes; none of them does the joins of the means again."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i, rng.random(), i % 2) for i in range(60)], "id long, a double, y int")
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60)], "src long, dst long")
    model, scored = features.graph_classifier(nodes, edges, "y", ["a"])
    assert "Join" not in plan(scored) and model.features == ["a", "a_1", "a_2"]
    means = {r.id: r.a_1 for r in scored.collect()}
    a = {r.id: r.a for r in nodes.collect()}
    near = {i: [a[(i * 7 + 1) % 60]] + [a[j] for j in range(60) if (j * 7 + 1) % 60 == i] for i in a}
    assert all(abs(means[i] - sum(near[i]) / len(near[i])) < 1e-12 for i in a)


def test_patch_arrays_look_nothing_up(spark):
    """An array is written from its cells in order, whatever their gaps: no map is searched for each place."""
    at = [(0, 1), (0, 2), (2, 0), (3, 3)]
    cells = spark.createDataFrame([(r, c, float(r + 1), float(c)) for r, c in at], "r long, c long, a double, y double")
    rows = S.patch_arrays(cells, ["a"], "y", 4, 4, 4, 4, 0.1)
    row = rows.first()
    assert row.mask == [int((r, c) in at) for r in range(4) for c in range(4)]
    assert row.x[0] == [float(r + 1) if (r, c) in at else 0.0 for r in range(4) for c in range(4)]
    assert row.y == [float(c) if (r, c) in at else 0.0 for r in range(4) for c in range(4)]
    assert "map" not in plan(rows).lower().replace("mapped", "")


def field(spark, seed=3, height=23, width=19):
    rng = random.Random(seed)
    z = {(r, c): float(rng.randint(0, 9)) for r in range(height) for c in range(width) if rng.random() > 0.05}
    return z, grid.kept(spark.createDataFrame([(r * width + c + 5, r, c, v) for (r, c), v in z.items()], "cid long, r long, c long, z double"))


def test_sinks_are_filled_over_tiles(spark):
    """Levels of tiles of any size are those of a plain flood, and no step joins cells with their neighbours."""
    z, cells = field(spark)
    near = {p: [q for dr, dc in grid.EIGHT if (q := (p[0] + dr, p[1] + dc)) in z] for p in z}
    level = {p: v if len(near[p]) < 8 else 1e9 for p, v in z.items()}
    while True:
        new = {p: min(level[p], max(z[p], min(level[q] for q in near[p]))) if near[p] else level[p] for p in z}
        if new == level:
            break
        level = new
    for size in (4, 7, 256):
        assert {(r.r, r.c): r.filled for r in tiles.filled(cells, "z", size).collect()} == level
    whole = grid.filled(cells)
    assert whole.columns == ["cid", "r", "c", "z", "filled"] and "join leftouter" not in plan(whole).lower()


def test_rings_are_followed_over_tiles(spark):
    """Rings that leave their tiles, and come back to them, have the names, places and corners that one tile gives them."""
    _, cells = field(spark, 4)
    parts = grid.kept(grid.components(cells.where("z <= 6").select("cid", "r", "c")))
    one = sorted(map(tuple, tiles.outline_points(parts).collect()))
    assert len({p[1] for p in one}) > 5
    for size in (3, 8):
        assert sorted(map(tuple, tiles.outline_points(parts, size=size).collect())) == one
    area = {r.component: r.area for r in grid.run_measures(grid.ring_runs(grid.outline_points(parts), 4)).groupBy("component").agg(F.sum("area").alias("area")).collect()}
    assert area == {r.component: r.n for r in parts.groupBy("component").agg(F.count("*").cast("double").alias("n")).collect()}


def test_op7_hears_the_resampled_sound(spark, tmp_path):
    """Resampling counts: samples of the feature are twice the payload's, and equal those of stored PCM of that rate."""
    from cellframe.llm import queries, telephony

    texts = ["", "a b c", "word " * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_telephony(spark, str(tmp_path)).collect()}
    assert all(f"n={2 * r.payload_bytes}," in r.feature.split(";")[0] for r in got.values())
    media = telephony.stored(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, bytes binary"))
    assert {r.doc_id: r.feature for r in telephony.media_digests(telephony.pcm_columns(media)).collect()} == {i: r.feature for i, r in got.items()}


def test_op7_stores_the_resampled_sound(spark, tmp_path, monkeypatch):
    """Media and the PCM of 16 kHz are written whole, and digests follow from the files; packed PCM of any kind comes back."""
    from cellframe.llm import queries, telephony

    texts = ["", "a b c", "word " * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables, real = [], telephony.written
    monkeypatch.setattr(telephony, "written", lambda *a, **b: tables.append(real(*a, **b)) or tables[-1])
    got = queries.op7_telephony(spark, str(tmp_path))
    files = {f for t in tables if "pcm" in t.columns for f in t.inputFiles()}
    assert [t.columns[-1] for t in tables] == ["media", "others"] and set(got.inputFiles()) == files != set()
    heard = {}
    for r in tables[1].collect():
        sound = np.frombuffer(telephony.unpacked(r.pcm), "<i2")
        heard[r.key] = len(sound), int(np.abs(sound.astype(int)).max())
        low = telephony.MULAW[np.frombuffer(telephony.padded(texts[r.key].encode()), np.uint8)]
        assert r.rate == 16000 and sound[::2].tolist() == low.tolist()
        assert sound[1::2].tolist() == [(int(a) + int(b)) // 2 for a, b in zip(low, [*low[1:], low[-1]])]
    assert {r.doc_id: r.feature.split(",turns")[0].split(",mean")[0] for r in got.collect()} == {i: f"mulaw@16000:n={n},peak={p}" for i, (n, p) in heard.items()}
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 64, 127):
        pcm = rng.choice([-32768, -1, 0, 1, 32767, *rng.integers(-32768, 32768, 9)], n).astype("<i2").tobytes()
        assert len(telephony.packed(pcm)) == len(pcm) and telephony.unpacked(telephony.packed(pcm)) == pcm


def test_token_ids_when_tables_are_full(monkeypatch):
    """A table of words or chunks that has grown too large is emptied between texts, and no text's words get lost."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cellframe.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_files.TextIds, "MOST", 20)
    rng = random.Random(9)
    own, lib = token_files.TextIds(path, "<u2"), Tokenizer.from_file(path)
    words = ["".join(rng.choice("abcdé'9.") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    most = 0
    for _ in range(60):
        texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(3)]
        got = own.encoded(pa.array(texts), np.array([2], "<u2").tobytes()).to_pylist()
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids + [2] for e in lib.encode_batch(texts, add_special_tokens=False)]
        most = max(most, len(own.words), len(own.chunks))
    assert most < 20 + 3 * 8 * 5 + 2  # bounded by the table and one lot


def test_forests_read_groups_of_like_rows(spark):
    """Passes read a row for each combination of bins, class and fold, however many rows there are, and open no node that can't be split."""
    rng = random.Random(8)
    rows = [(rng.getrandbits(60), int(a + b + rng.random() > 3), k % 3, [a, b]) for k in range(3000) if (a := rng.randint(0, 3)) is not None and (b := rng.randint(0, 3)) is not None]
    table = spark.createDataFrame(rows, "h long, y byte, fold byte, x array<byte>")
    groups = forests.counted(table, 2, 2, 7).collect()
    assert len(groups) == len({(tuple(x), y, f) for _, y, f, x in rows}) < 100 and sum(g.n for g in groups) == 3000
    draws = {t: forests.times_drawn(np.array([h for h, *_ in rows]), t, 7) for t in range(2)}
    for g in groups:
        mine = [i for i, (_, y, f, x) in enumerate(rows) if (y, f, x) == (g.y, g.fold, [g.x0, g.x1])]
        assert g.n == len(mine) and g.w == [draws[t][mine].sum() for t in range(2)] and g.m == [(draws[t][mine] > 0).sum() for t in range(2)]
    family = forests.Setting(2, 1).family()
    made = []
    real = forests._sums
    forests._sums = lambda trees, *rest: made.append(rest[2]) or real(trees, *rest)
    try:
        trees = forests.grown(table, 2, {(family, 0): 2}, bins=4, seed=7)
    finally:
        forests._sums = real
    assert made == [2] and all(len(t.feature) == 3 and 0 <= min(t.share) < max(t.share) <= 1 for t in trees)


def test_jobs_score_cells_without_a_join(spark):
    """Cells go through the scores as whole rows and aren't joined with their own scores; cells without an index stay."""
    rows = [(i, i // 4, i % 4, 1.5 * i, 2.0 + i if i % 5 else None) for i in range(12)]
    cells = grid.kept(spark.createDataFrame(rows, "cid long, r long, c long, z double, g double"))
    band = grid.kept(cells.where("cid <> 3").select("r", "c", (0.02 + 0.001 * F.col("cid")).alias("value")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are large
    try:
        made = [(jobs.scored(cells, job_settings({"inputs": inputs}, "/nowhere"), rasters), rasters) for inputs, rasters in (({}, {}), ({"na": {"mode": "raster", "units": "manning"}}, {"na": band}))]
        assert all("SortMergeJoin [cid" not in got._jdf.queryExecution().executedPlan().toString() for got, _ in made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for got, rasters in made:
        found = {r.cid: r for r in got.collect()}
        assert {k: (k, r.r, r.c, r.z, r.g) for k, r in found.items()} == {r[0]: r for r in rows}
        assert got.columns == ["cid", "r", "c", "z", "g", "pci", "c_model_mean"]
        missing = {r[0] for r in rows if r[4] is None} | ({3} if rasters else set())
        assert {k for k, r in found.items() if r.pci is None} == {k for k, r in found.items() if r.c_model_mean is None} == missing


def test_terrain_meets_as_tiles(spark):
    """Cells are shuffled to tiles for their surface; what flows through them and their slopes come with it, and no cell is joined by its id."""
    rng = random.Random(8)
    rows = [(100 + 7 * (r * 11 + c), r - 3, c, float(rng.choice([1, 1, 2, 5]) + (r + c) // 6)) for r in range(13) for c in range(11) if rng.random() < 0.93]
    cells = grid.kept(spark.createDataFrame(rows, "cid long, r int, c int, z double"))
    for offsets, across in ((grid.FOUR, True), (grid.EIGHT, False)):
        full = grid.kept(tiles.filled(cells, "z", 4) if across else cells.withColumn("filled", F.col("z")))
        flow = tiles.drained(full, "filled", offsets, 4) if across else grid.kept(tiles.flow_of_descent(full, "filled", offsets, 4))
        want = full.join(tiles.accumulated(flow, 4), "cid").join(tiles.receivers(full, "filled", 10.0, offsets, 4).select("cid", "slope"), "cid", "left").fillna(0.0, ["slope"])
        got = tiles.relief(full, "z", "filled", 10.0, offsets, across, 4)
        assert got.dtypes == [("cid", "bigint"), ("r", "int"), ("c", "int"), ("z", "double"), ("filled", "double"), ("cells_up", "bigint"), ("slope", "double")]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == len(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are large
    try:
        assert "Join [cid" not in jobs.terrain(cells, 10.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tiles.relief(cells.where("z < 0"), "z", "z").collect() == []
