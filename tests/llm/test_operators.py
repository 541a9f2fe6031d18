"""The training-data operators against their libraries and against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from cellframe.llm import html_diff, license_scan, piece_codec, quality, secret_scan, setsketch, telephony, templates, token_count, token_files  # noqa: E402

ODD = [None, "", " ", "a", "  two  words ", "x" * 3000, "日本 é\n\n", "<|endoftext|> b", "▁▁ a", "don't I'M", "Wort*** ein&&& 12", "a.*b 'S", "🎉 " * 30]


def table(spark, texts, extra=True):
    rows = [(i if i % 5 else (None if i == 0 else i), t, "en" if i % 2 else None, f"s{i % 3}", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_count.token_counts(table(spark, ODD), P.path("byte_bpe_50k.json")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) for x in ODD)
    assert token_count.token_counts(table(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_piece_codec():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), piece_codec.codec_of(P.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + [" " * n + "Hello" + " " * n for n in range(40)] + ["".join(rng.choice(" ▁ab\n\tthe éß日🎉01'.") for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert own.encode(t) == lib.encode(t)
        assert own.decode(own.encode(t)) == lib.decode(lib.encode(t))


def test_piece_codes_of_nulls(spark):
    got = piece_codec.piece_codes(table(spark, [None, "ab", "ab"]), P.path("piece_bpe_32k.model")).collect()
    assert sorted(len(r.ids) for r in got)[0] == 0 and sorted(r.decoded for r in got) == ["", "ab", "ab"]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = table(spark, ODD)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/x", path, 2, partitions=3)
    got = token_files.read_token_files(spark, manifest, f"file://{tmp_path}/x").orderBy("start").collect()
    start = 0
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ids = t.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in got] == sorted(by_id, key=lambda x: (x is not None, x))
    assert token_files.token_file_round_trip(table(spark, []), path, 2).count() == 0


def test_token_shards(spark):
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3, 9]), rng.randrange(-50, 50)) for _ in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    lows = [order[k] for k in (50, 120, 180, 240, 300, 360)]
    parts = token_files.Shards(lows).of(pa.array([r[0] for r in rows], pa.int64()), np.array([r[1] for r in rows]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert parts.tolist() == [sum(key(low) <= key(r) for low in lows) for r in rows]
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(50)], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, f"{token_files.shared_dir(spark)}/x", P.path("word_bpe_49k.json"), 2, partitions=5)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_docs")).first()[0] == 350


def test_token_ids_against_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), token_files.TextIds(path, "<u2")
    assert own.by_word and not token_files.TextIds(P.path("byte_bpe_50k.json"), "<u2").by_word
    rng = random.Random(3)
    signs = [*"abzABZ019 \t\n'.,!?*&<|>-_éßüÉİıΣσ日\U0001f389ªµ×÷jJKk", "\u0301", "\u030c", "\u00a0", "\u2003", "\u200b", "\x85", "\x1c", "\x0b", "\r", "\ufb01", "\u212a", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", " 'd"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(20000)] + [None, "", " ", "word " * 5000]
    got = own.encoded(pa.array(texts, pa.string()), np.array([2], "<u2").tobytes()).to_pylist()
    want = [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want
    whole = token_files.TextIds(P.path("byte_bpe_50k.json"), "<u2")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = whole.encoded(pa.array(texts[:500]), np.array([2], "<u2").tobytes()).to_pylist()
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts[:500]]


def test_telephony(spark):
    docs = table(spark, ODD).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    got = {(r.n_bytes, r.payload_sha256) for r in telephony.media_digests(telephony.pcm_columns(telephony.stored(docs))).collect()}
    want = set()
    for t in ODD:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.add((len(b), hashlib.sha256(p).hexdigest()))
    assert got == want
    assert telephony.MULAW[0] == -32124 and telephony.MULAW[255] == 0 and telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x55] == -8
    sounds = {r.payload_sha256: r for r in telephony.pcm_columns(telephony.stored(docs, "adpcm")).collect()}
    assert len(sounds) == len({digest for _, digest in want}) and {r.rate for r in sounds.values()} == {16000}
    one = np.frombuffer(sounds[hashlib.sha256(bytes(64)).hexdigest()].pcm, "<i2")
    assert len(one) == 2 * 121 and one[0] == 0
    assert telephony.media_digests(telephony.pcm_columns(telephony.stored(docs.limit(0)))).count() == 0


def test_resampled():
    rng = np.random.default_rng(5)
    sizes = [64, 5, 1, 130]
    pcm, ends = rng.integers(-32768, 32768, sum(sizes)).astype(np.int16), np.cumsum(sizes)
    for rate in (16000, 4000, 12000, 6000, 8000):
        out, stops = telephony.resampled(pcm, ends, rate)
        up, down = (rate // 2000, 4)
        want = []
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            x = pcm[lo:hi].astype(int).tolist()
            for k in range(len(x) * up // down):
                i = k * down // up
                if up >= down:
                    part = k * down % up
                    want.append((x[i] * (up - part) + x[min(i + 1, len(x) - 1)] * part) // up)
                else:
                    j = max(i + 1, (k + 1) * down // up)
                    want.append(sum(x[i:j]) // (j - i))
        assert out.tolist() == want and stops[-1] == len(want)


def test_common_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        kept = html_diff.common_lines(a, b)
        rest = iter(b)
        assert len(kept) == size[-1][-1] and all(any(y == a[i] for y in rest) for i in kept)


def test_common_lines_by_halves(monkeypatch):
    monkeypatch.setattr(html_diff, "HELD", 20)
    test_common_lines()


def test_long_pages_are_aligned_in_little_memory():
    import resource

    rng = random.Random(3)
    a = [rng.randrange(1 << 60) for _ in range(200_000)]
    b = [x if rng.random() < 0.99 else rng.randrange(1 << 60) for x in a]
    rng.shuffle(moved := a[50_000:51_000])
    b[120_000:120_000] = moved
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    kept = html_diff.common_lines(a, b)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB
    rest = iter(b)
    assert len(kept) >= 197_000 and kept == sorted(set(kept)) and all(any(y == a[i] for y in rest) for i in kept)


def test_article_lines_and_headings_stay(spark):
    lead = "Lead sentence that the neighbour prints too"
    pages = [
        (1, "http://a.org/1", f"<title>{lead}</title><nav>x</nav><article><h1>{lead}</h1><p><b>{lead}<br><p>One</p><p>Shared end</p></article>"),
        (2, "http://a.org/2", f"<article><h1>{lead}</h1><p>Two</p><p>Shared end</p></article>"),
        (3, "http://b.org/1", f"<title>{lead}</title><body><p>Frame</p><h1>Head</h1><p>{lead}</p><p>Three</p></body>"),
        (4, "http://b.org/2", f"<body><p>Frame</p><h1>Head</h1><p>{lead}</p><p>Four</p></body>"),
        (5, "http://c.org/1", "<article><p>Text</p><div class='comments-list'><p>Reader</p></div><div class='site-footer'>f</div><ul class='main-nav'><li>n</li></ul></article>"),
    ]
    got = {r.page_id: r for r in html_diff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1].text == f"{lead}\n{lead}\nOne\nShared end" and got[2].text == f"{lead}\nTwo\nShared end"
    assert got[3].text == f"Head\n{lead}\nThree" and got[4].text == "Head\nFour" and got[4].n_dropped == 2
    assert got[5].text == "Text"


def test_main_text(spark):
    frame = "<ul><li>Home</li></ul><p>About this site</p>"
    pages = [
        (1, "http://h.org/a/1", f"<title>t</title><body>{frame}<p>One &amp; two</p></body>"),
        (2, "http://h.org/a/2", f"<body>{frame}<p>Other  <b>text</b></p><div class='comments'>no</div></body>"),
        (3, "http://h.org/b", "<nav>x</nav><article><h1>T</h1><p>a<br>b<script>var p='</p>'</script></article><footer>f</footer>"),
        (4, None, None),
        (5, "http://h.org/b", "<article><p>cut &am"),
    ]
    got = {r.page_id: r for r in html_diff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(1, 6)] == ["One & two", "Other text", "T\na\nb", "", "cut &am"]
    assert got[1].n_shared == 2 and got[4].n_chars == 0


def test_main_text_of_copies_frames_and_classes(spark):
    frame = "<p>About this site</p><p>All rights reserved</p>"
    body = "<p>A story that was printed twice, word for word, by two pages of a host</p>"
    pages = [
        (1, "http://a.org/x?page=1", f"{frame}<p>Same page</p>"),
        (2, "http://a.org/x?page=2", f"{frame}<p>Same page</p>"),
        (3, "http://a.org/y", f"{frame}<p>Other page</p>"),
        (4, "http://b.org/1", "<main><p>Site line</p><p>One body that is long enough to be a text</p></main>"),
        (5, "http://b.org/2", "<main><p>Site line</p><p>Another text, unlike the first in all its words</p></main>"),
        (6, "http://c.org/1", f"<article><p>First</p>{body}</article>"),
        (7, "http://c.org/2", f"<article><p>Second</p>{body}</article>"),
        (8, "http://d.org/1", "<body class='menu'><div class='no-sidebar'>kept</div><div class='Sidebar x'>gone</div></body>"),
    ]
    got = {r.page_id: r for r in html_diff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in (1, 2, 3)] == ["Same page", "Same page", "Other page"]
    assert [got[k].text for k in (4, 5)] == ["One body that is long enough to be a text", "Another text, unlike the first in all its words"]
    assert got[4].n_dropped == 1 and got[8].n_dropped == 0
    assert got[6].text.startswith("First\nA story") and got[7].text.startswith("Second\nA story")
    assert got[8].text == "kept"


def test_pages_against_plain_differencing(spark):
    """Sites without an article: what is left is what a quadratic alignment with the nearest path leaves."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(200)]
    line = lambda: " ".join(rng.choice(words) for _ in range(8))
    pages, bodies = [], {}
    for host in range(3):
        frame = [line() for _ in range(6)]
        for page in range(12):
            body = [line() for _ in range(rng.randrange(1, 9))]
            cut = rng.randrange(1, 5)
            lines = frame[:cut] + body + frame[cut:]
            bodies[len(pages)] = (host, f"/p/{page:02d}", lines, body)
            pages.append((len(pages), f"http://h{host}.org/p/{page:02d}", "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"))
    got = {r.page_id: r for r in html_diff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, (_, _, lines, body) in bodies.items():
        assert got[k].text.split("\n") == body and got[k].n_dropped == len(lines) - len(body)


def test_pages_keep_text_beside_teasers_and_odd_classes(spark):
    long = "<p>" + "a body of many words that is the text of this page " * 3 + "</p>"
    pages = [
        (1, "http://a.org/1", f"<body class='single-post comments-open'>{long}</body>"),
        (2, "http://b.org/1", f"<body class='has-sidebar'><main><section id='notice-of-appeal'>{long}</section></main></body>"),
        (3, "http://c.org/1", f"<article><div class='social-history'>{long}</div></article>"),
        (4, "http://d.org/1", f"<article><p>Teaser</p></article><div>{long}</div>"),
    ]
    table = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_diff.main_text(table).collect()}
    assert all("a body of many words" in t for t in got.values()) and len(got) == 4
    assert html_diff.main_text(table.limit(0)).count() == 0
    big = spark.createDataFrame([(1, "u", "<p>word</p>" * 50000), (1, "u", "<p>word</p>" * 50000)], "page_id long, url string, html string")
    assert [r.n_lines for r in html_diff.main_text(big).collect()] == [50000, 50000]


def test_license_scan(spark):
    texts = ["Licensed under the Apache License, Version 2.0. ALL rights  reserved", None, "", "cc by cc by", "the general public license", "mit und so", "cc by nc 4.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[0].labels == "apache-2.0,reserved" and got[0].score == 1.0 and got[0].first_word == 8
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].n_words) == (2, 0, 2, 4)
    assert got[1].n_words == got[2].n_words == 0 and got[5].labels == "" and got[6].labels == "cc-by,cc-by-nc-4.0"
    assert len(license_scan.rules()) > 300


def test_license_names_and_many_matches(spark):
    texts = ["SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-or-later", "under BSD-3-Clause here", "GPLv3+", "Licensed under CC BY-NC 4.0.", "all rights reserved " * 20000, "Some prose about trains and a license plate"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [got[k].labels for k in (0, 1, 2, 3, 6)] == ["mit", "gpl-2.0-or-later", "bsd-3-clause", "gpl-3.0", ""]
    assert got[4].labels == "cc-by,cc-by-nc-4.0" and got[4].base_labels == "cc-by" and got[4].first_word == 2
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].n_words) == (20000, 0, 59997, 60000)
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_license_keywords_are_in_every_match():
    # a rule's shortest match leaves out all that may be absent
    for _, _, keyword, pattern, _ in license_scan.rules():
        least = re.sub(r"\(\?: (?:[^()]|\(\?:[^()]*\))* \)\?", "", pattern)
        assert license_scan.unit(keyword) in least, (keyword, pattern)


def test_secret_candidates_against_ungated_patterns():
    texts = ["ap\u0131key=abcdefghijklmnop", "Pa\u017f\u017fwd: 'abcdefghijklmnop'", "TO\u212aEN=abcdefghijklmnop", "AP\u0130_KEY=abcdefghijklmnop", "BEARER " + "a" * 25, "ghp_" + "A1" * 20, "AKIA" + "B" * 16]
    texts += ["-----BEGIN RSA PRIVATE KEY-----\nabc", "pg://u:secretpw@h", "deadbeef" * 2 + "g" + "a" * 15, "token=short", "AIza" + "b" * 35, "eyJ" + "a" * 9 + ".bbbbbbbbb.ccccccccc", "xoxb-" + "1" * 12, ""]
    patterns = [(secret_scan.ASSIGN, 2, 12), (secret_scan.ACCESS, 0, 18), (re.compile(r"[0-9a-f]+"), 0, 16), *((p, g, 0) for _, p, g, _ in secret_scan.MORE)]
    for text in [*texts, "\n".join(texts)]:
        want = sorted((m.start(), k, m.end(), m[g]) for k, (p, g, least) in enumerate(patterns) for m in p.finditer(text) if len(m[g]) >= least)
        assert secret_scan.candidates(text) == want and (want or text in ("", "token=short"))


def test_secret_scan(spark):
    shared, own = "AKIA" + "B" * 16, "deadbeef" * 4
    rows = [(i, f"key {shared} end", "en", f"o{i}") for i in range(4)] + [(9, f'password = "{own}" x', "en", "o1"), (10, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_report(docs, F.col("lang"), F.col("source")).collect()}
    assert got[0].n_access == 1 and got[0].live_spans == "" and got[0].most_owners == 4
    assert got[9].spans == "assign:0:44,hex:12:44" and got[9].live_spans == got[9].spans and got[10].spans == ""
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs, F.col("lang"), F.col("source")).collect()}
    assert clean[9] == '[secret]" x' and clean[0] == rows[0][1] and clean[10] is None


def brute_components(docs, width, percent):
    sets = {d: setsketch.shingle_set(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) and len(sets[b]):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(0, " ".join(base)), (1, ""), (2, None), (3, "one two"), (4, "one  TWO")]
    for i in range(5, 160):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(docs, 4, 80)
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contaminated(spark):
    item = "A train leaves the old station with 40 kg of coal and reaches Berlin after 3 hours of travel today"
    other = item.replace("40", "75").replace("Berlin", "Madrid")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny item here")], "item_id long, text string")
    docs = [(1, f"foo. {item}"), (2, f"bar. {other}"), (3, "nothing of that kind is here at all in this text"), (4, None), (5, "see the tiny item here now")]
    got = {r.doc_id: r for r in templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert [got[k].contaminated for k in range(1, 6)] == [True, True, False, False, True]
    assert got[2].reparameterised and not got[1].reparameterised


def test_contaminated_runs_and_short_items(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    item = f"first 7 {' '.join(words)} then 7 more"
    bench = spark.createDataFrame([(1, item), (2, "42"), (3, "7 8 Berlin"), (4, "the"), (5, "tiny 4 item here")], "item_id long, text string")
    docs = [(1, item.replace("then 7", "then 9")), (2, "in all the 17 cases"), (3, "Of 5 6 Madrid"), (4, "see 42 here"), (5, "a tiny 6 item here"), (6, "so 7 8 Berlin")]
    got = {r.doc_id: r for r in templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert [(k, got[k].items) for k in range(1, 7)] == [(1, "1"), (2, ""), (3, ""), (4, ""), (5, "5"), (6, "3")]
    pair = lambda at, *p: {"at": at, "pairs": [{"a": a, "b": b} for a, b in p]}
    runs = [pair(0, ("2", "3")), pair(1, ("2", "3")), pair(2, ("2", "3"), ("2", "5")), pair(3, ("2", "5")), pair(4), pair(9, ("2", "3"))]
    assert [w["at"] for w in templates.consistent(runs)] == [0, 1, 4, 9]


def test_unrelated_numbers_are_clean(spark):
    rng = random.Random(9)
    table = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    item, names = table(2000), " ".join("said Ann Bob Eve".split()[1 + k % 3] for k in range(500))
    bench = spark.createDataFrame([(1, item), (2, "A list of " + names)], "item_id long, text string")
    docs = [(k, table(2000)) for k in range(50)] + [(100, f"see {item} end"), (101, "then " + " ".join(rng.choice(["Kim", "Lea", "Tom"]) for _ in range(500))), (102, "7 " * 5000)]
    got = {r.doc_id: r for r in templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {100} and got[100].items == "1" and got[100].coverage == 1.0
    equal = spark.createDataFrame([(3, "7 " * 3000)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), equal).collect()}
    assert [k for k, v in got.items() if v] == [102]


def test_exchange_is_the_fit_on_labels_and_all_pseudo_labels(spark):
    """After enough steps the weights are those of a plain fit on labelled rows and every confident row of the pool."""
    import numpy as np

    rng = np.random.default_rng(5)

    def rows(n):
        y = rng.integers(0, 2, n)
        content = np.clip(rng.normal(100, 20, (n, quality.WIDTHS[0])), 0, 255).astype(np.uint8)
        content[:, :40] = np.clip(rng.normal(90 + 40 * y[:, None], 12, (n, 40)), 0, 255)
        metadata = rng.normal(0, 1, (n, quality.WIDTHS[1])).astype("<f4")
        metadata[:, 50] += 9 * y
        return content, metadata, y.astype(float)

    content, metadata, label = rows(200)
    learner = quality.Learner([content / quality.SCALE, metadata.astype(float)], label)
    c, m, _ = rows(600)
    pool = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes())) for a, b in zip(c, m, strict=True)], "content binary, metadata binary").repartition(3)
    start = [w.copy() for w in learner.models]
    views = [c / quality.SCALE, learner.plain(1, m.astype(float))]
    loss, taught = [], {}
    for k in (0, 1):
        assert learner.trusted(1 - k, 0, 0.9) and learner.trusted(1 - k, 1, 0.9)
        p = quality.chance(quality.logit(views[1 - k], start[1 - k]))
        good, bad = p >= 0.9, p <= 0.1
        taught |= {(1 - k, 0): int(bad.sum()), (1 - k, 1): int(good.sum())}
        use, train = good | bad, ~learner.held
        weight = np.append(np.ones(train.sum()), np.full(use.sum(), min(0.5, train.sum() / use.sum())))
        x, y = np.vstack([learner.views[k][train], views[k][use]]), np.append(label[train], good[use])

        def value(w, k=k, x=x, y=y, weight=weight):
            z = quality.logit(x, w)
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + learner.RIDGE[k] / 2 * w @ w)

        loss.append((value, value(start[k]), value(quality.fitted(x, y, weight, learner.RIDGE[k], 50))))
    quality.exchange(pool, learner, 0.9, 40)
    assert learner.history[0]["pseudo_labels"] == taught and min(taught.values()) > 100
    for k in (0, 1):
        value, before, best = loss[k]
        assert value(learner.models[k]) - best < 0.02 * (before - best)


def test_quality(spark):
    rng = random.Random(6)
    words = ["river", "stone", "house", "green", "walks", "under", "light", "paper"]
    rows = []
    for i in range(240):
        good = i % 3 > 0
        w = [rng.choice(words) for _ in range(40)]
        rows.append((i, " ".join(w) + "." if good else "*** ".join(w).upper(), "en", f"s{i % 4}", int(good)))
    docs = spark.createDataFrame([r[:4] for r in rows] + [(None, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    assert sum(got[r[0]] == bool(r[4]) for r in rows) >= 230 and len(got) == 241
    none = quality.train(docs, labels.limit(0))
    assert all(r.keep for r in quality.scored(docs, none).collect())
