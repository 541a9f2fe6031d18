"""Every query on tables with nulls, empty and very long texts, repeated rows, clashing column names, and on empty tables."""

import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from cellframe.llm import queries  # noqa: E402

CLASH = "key string, slot int, row string, id string, host string, same string, hash int, rank int, node int, component int, component_id int, label string, score string, keep string, n_bytes int, media string, pcm string, part int, tie int, ids string, raw string, spaced string, lines string, found string, cut string, content string, h double"
EXTRA = ["k", 1, "r", "i", "h", "s", 1, 2, 3, 4, 5, "l", "s", "k", 6, "m", "p", 7, 8, "i", "r", "s", "l", "f", "c", "c", 0.5]
LONG = "Licensed under CC BY 4.0. the quick brown fox, password = 'abcdefghijklmnop' été 42 km " * 3000
TEXTS = [None, "", " ", "one", "one", LONG, LONG, "x" * 100000, "日本 é\n\n🎉", "a\x00b", "cc by cc by", "All rights reserved"]
DOCS = [(None if i == 3 else i // 2, t, None if i % 3 else "en", None if i % 4 else "src", None, *EXTRA) for i, t in enumerate(TEXTS)]
EXTRA_V = ["u", "t", "v", 1]
HTML = [None, "", "<p>", f"<article><p>{LONG}</p></article>", "<p>a</p>" * 20000, "<p>a</p>", "<p>a</p>"]


VECTORS = [(0, [0.5, 0.1], 1), (0, [0.5, 0.1], 1), (None, [0.4, 0.2], 3), (50, None, 1), (7, [None, 0.1], 1), (8, [], 3), (9, [0.4], None), (10, [0.4, 0.3], 3)]


def written(spark, folder, docs, pages, labels, benchmark, vectors=()):
    spark.createDataFrame([(*v, *EXTRA_V) for v in vectors], "vec_id long, embedding array<float>, label int, uid string, tree string, vector string, ids int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, f"page_id long, url string, html string, {CLASH}").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    pages = [(None if i == 2 else i, None if i == 1 else f"http://h/{i // 2}", h, *EXTRA) for i, h in enumerate(HTML)]
    return written(spark, tmp_path_factory.mktemp("odd"), DOCS, pages, [(0, 1, 0), (None, 0, 0), (2, None, 0), (2, 1, 1), (2, 0, 1)], [(1, None), (2, ""), (3, "the quick brown fox"), (None, "one two three")], VECTORS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    if name.startswith("op12_"):
        assert {r.word: r.n for r in rows}["licensed"] == 6000 and all(r.root == r.word for r in rows)
        return
    if name.startswith("op13_"):
        assert {(r.anchor_id, r.positive_id) for r in rows} == {(0, 0)} and {r.negative_id for r in rows} == {10, None}
        return
    assert len(rows) == len(HTML if name == "op1_page_text" else TEXTS)
    if name != "op1_page_text":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in DOCS)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_values_of_odd_texts(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sorted((r.n_bytes, r.n_tokens) for r in queries.QUERIES["op2_token_counts"](spark, odd).collect()) == sorted((len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in texts)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in (lib.encode(t, add_special_tokens=False).ids + [2] for t in texts))
    assert sorted((r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_token_files"](spark, odd).collect()) == want
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted(hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest() for t in texts)
    assert sorted(r.ids_sha256 for r in queries.QUERIES["op10_piece_codec"](spark, odd).collect()) == want
    found = queries.QUERIES["op8_near_duplicates"](spark, odd).collect()
    assert {(r.doc_id, r.component_id) for r in found if r.n_shingles > 1} == {(2, 2), (3, 2)}
