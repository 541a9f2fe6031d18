"""The pipeline's stages against brute force, on tables with odd rows."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from cellframe.llm import piece_codec, quality, secret_scan, setsketch, templates  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, _cut string, id long, tie long, row string, slot int, component_id long"
WORDS = [f"word{k}" for k in range(400)]


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def corpus():
    """Clean texts, copies, junk, benchmark items, secrets, nulls, empty texts and repeated ids, with columns of clashing names."""
    rng = random.Random(21)
    texts = [prose(rng) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t) for i, t in enumerate(texts[:5])]  # exact copies
    rows += [(200 + i, t.replace("word7", "other") + " end") for i, t in enumerate(texts[5:12])]  # near ones
    rows += [(300 + i, "*** " + " ### ".join("$$%&!!" for _ in range(40))) for i in range(12)]
    rows += [(400, f"see {ITEM} indeed {prose(rng)}"), (401, f'token = "{"deadbeef" * 4}" {prose(rng)}')]
    rows += [(500, None), (501, ""), (502, " "), (None, prose(rng)), (None, None), (7, prose(rng)), (7, texts[7]), (7, texts[7]), (503, "x" * 20000), (504, "one two")]
    return [(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 4}", None if t is None else len(t), "k", "a", "b", 1, 2, "r", 3, 4) for d, t in rows]


ITEM = "A train leaves the old station with 40 kg of coal and reaches Berlin after 3 hours of travel today"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int("$" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] != 7 and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=repr)


def test_quality_stage(spark, docs, sf_dir):
    got = pipeline.reject_low_quality(spark, docs, sf_dir)
    left = rows_of(got)
    assert got.columns == docs.columns
    assert not any("$" in (t or "") for _, t in left)
    clean = [r for r in rows_of(docs) if r[1] and "word" in r[1]]
    assert all(r in left for r in clean)


def test_quality_stage_keeps_columns_of_its_own_names(spark, docs, sf_dir):
    named = docs.select("*", F.concat(F.lit("own "), F.coalesce("text", F.lit(""))).alias("score"), F.lit("k").alias("keep"), F.lit(1).alias("P_content"))
    got = pipeline.reject_low_quality(spark, named, sf_dir)
    assert got.columns == named.columns and rows_of(got) == rows_of(pipeline.reject_low_quality(spark, docs, sf_dir))
    assert all((r.score, r.keep, r.P_content) == ("own " + (r.text or ""), "k", 1) for r in got.collect())


def test_near_duplicate_stage(spark, docs, sf_dir):
    got = pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    every = rows_of(docs)
    nodes = [(k, r, setsketch.shingle_set(r[1], 5)) for k, r in enumerate(every)]
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, x in nodes:
        for j, b, y in nodes[:i]:
            if a[0] is not None and b[0] is not None and len(x) and len(y):
                both = len(set(x.tolist()) & set(y.tolist()))
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    root[find(i)] = find(j)
    ties = {(r.doc_id, r.text): r.tie for r in docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()}
    best = {}
    for k, r, s in nodes:
        if r[0] is not None and len(s):
            best[find(k)] = min(best.get(find(k), (1 << 62, 0, None)), (r[0], ties[r], r))
    want = [r for _, _, r in best.values()] + [r for _, r, s in nodes if r[0] is None or not len(s)]
    assert rows_of(got) == sorted(want, key=repr)


def test_decontamination_stage(spark, docs, sf_dir):
    got = pipeline.drop_contaminated(spark, docs, sf_dir)
    assert got.columns == docs.columns
    item, _ = templates.canonical(ITEM)

    def leaks(text):
        tokens, _ = templates.canonical(text)
        return any(tokens[k : k + len(item)] == item for k in range(len(tokens)))

    assert rows_of(got) == [r for r in rows_of(docs) if not leaks(r[1])] and len(rows_of(got)) < docs.count()


def test_secret_stage(spark, docs, sf_dir):
    got = pipeline.redact_secrets(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.count() == docs.count()
    owners = {}
    for r in docs.collect():
        for *_, value in secret_scan.candidates(r.text or ""):
            owners.setdefault(value, set()).add(r.source)

    def clean(text):
        out, at = "", 0
        for start, _, stop, value in secret_scan.candidates(text or ""):
            if len(owners[value]) < 3:
                if start >= at:
                    out += text[at:start] + "[secret]"
                at = max(at, stop)
        return text if not at else out + text[at:]

    assert rows_of(got) == sorted([(d, clean(t)) for d, t in rows_of(docs)], key=repr)
    assert any("[secret]" in (t or "") for _, t in rows_of(got))


def test_piece_stage(spark, docs, sf_dir):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = pipeline.encode_pieces(spark, docs, sf_dir)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted((d or -1, len(lib.encode(t or ""))) for d, t in rows_of(docs))
    assert piece_codec.piece_digests(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_stages_of_empty_tables(spark, docs, sf_dir):
    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert 400 not in ids and 401 in ids and 100 not in ids and 0 in ids and 300 not in ids
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model.joint is not None


def test_ownership_of_planted_credentials(spark):
    shared, few, own = "AKIA" + "B" * 16, "AKIA" + "C" * 16, "AKIA" + "D" * 16
    rows = [(i, f"use {shared}", "en", f"owner{i % 5}") for i in range(50)]
    rows += [(100 + i, f"use {few}", "en", f"owner{i % 2}") for i in range(6)] + [(200, f"use {own} and {shared}", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_report(docs, F.col("lang"), F.col("source")).collect()}
    assert got[0].most_owners == 6 and got[0].live_spans == "" and got[0].spans == "access:4:24"
    assert got[100].most_owners == 2 and got[100].live_spans == "access:4:24"
    assert got[200].live_spans == "access:4:24" and got[200].spans == "access:4:24,access:29:49"
    assert secret_scan.secret_report(docs.limit(0), F.col("lang"), F.col("source")).count() == 0
