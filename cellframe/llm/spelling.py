"""Grouping spelling variants: edit-matrix rows over sorted vocabularies, reused along shared prefixes."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, lots, written

#: Words of a list that one task compares at once; longer lists are compared in blocks of about so many.
BLOCK = 4096
#: Different words that a task gathers before it hands their counts on.
GATHERED = 200_000
#: Doublings of the way from a word to its root: counts rise fivefold or more a step, so a way has at most 27 steps below 2^63.
DOUBLINGS = 5


def words_of(docs: DataFrame, least: int, modulus: int) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters of at least ``least`` code points after the planted slip, and how often they occur.

    Runs are letters A-Z, a-z and U+00C0 to U+00FF; A-Z alone are lower-cased. Where the checksum of
    "id:run" is divisible by ``modulus``, one letter is left out. A row without an id has no slip; null
    and empty texts have no runs. Rows are counted in the scan's tasks before they are shuffled.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches):
        found: dict[str, int] = {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for lot in lots(batch):
                for doc, text in zip(lot[0].to_pylist(), lot[1].to_pylist(), strict=True):
                    if not text:
                        continue
                    mine: dict[str, int] = {}
                    for word in run.findall(text.lower() if text.isascii() else text.encode().lower().decode()):
                        mine[word] = mine.get(word, 0) + 1
                    start = None if doc is None else zlib.crc32(b"%d:" % doc)
                    for word, n in mine.items():
                        if start is not None and (h := zlib.crc32(word.encode(), start)) % modulus == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        found[word] = found.get(word, 0) + n
                    if len(found) > GATHERED:
                        yield out()
        if found:
            yield out()

    bounded_batches(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def lists(words: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """``(list, half, back, key, n, scanned, asked)``: sorted lists in which any two words one edit apart meet once.

    Of two such words, the shorter with ``s`` letters, the first or the last ``s // 2`` letters agree. So each word is
    filed under its first and, read backwards, its last letters, for its own length and for one letter less.
    A list of more than ``block`` words is split by hash into k blocks, and each block's words are scanned once
    against each block's: a word's rows go up to 2 k - 1 and no list is held whole. ``least`` is the shortest word's length.
    """
    length, back = F.length("word"), F.reverse("word")
    halves = F.filter(F.array_distinct(F.array(F.floor(length / 2), F.floor((length - 1) / 2)).cast("array<int>")), lambda h: h >= least // 2)
    filed = words.select("word", "n", back.alias("turned"), F.explode(halves).alias("half"))
    filed = filed.select("n", "half", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("key")), F.struct(F.lit(True).alias("back"), F.col("turned").alias("key")))).alias("f")).select("n", "half", "f.*")
    filed = filed.withColumn("name", F.concat(F.col("half").cast("string"), F.when(F.col("back"), "<").otherwise(">"), F.substring("key", F.lit(1), F.col("half"))))
    long = written(filed.groupBy("name").count().where(F.col("count") > block).select(F.col("name").alias("long"), F.ceil(F.col("count") / block).cast("int").alias("k")))
    split = filed.join(long, filed["name"] == long["long"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    pairs = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.col("own").alias("i"), i.alias("j"))), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))))
    out = split.select("name", "half", "back", "key", "n", "own", F.explode(pairs).alias("p"))
    return out.select(F.concat_ws(":", "name", "p.i", "p.j").alias("list"), "half", "back", "key", "n", (F.col("p.i") == F.col("own")).alias("scanned"), (F.col("p.j") == F.col("own")).alias("asked"))


def scan(half: int, back: bool, scanned: list[tuple[str, int]], asked: list[tuple[str, int]]):
    """``(word, near, n, best)`` for each scanned word that is one edit from an asked one; all share their first ``half`` letters.

    The scanned words are read in sorted order. A row of the edit matrix, of which the three
    cells beside the diagonal matter, holds all asked words at once, and only those are carried on that have a
    cell of at most one. Rows of a prefix are kept for the next word, as far as both agree; a prefix of
    which no asked word is left ends the whole range of words that begin with it.
    """
    if len(asked) == 1 and scanned == asked:
        return
    words, wide = [w for w, _ in asked], max(len(w) for w, _ in asked)
    letters = np.zeros((len(asked), wide + 3), np.uint32)
    lengths = np.array([len(w) for w in words])
    for row, word in enumerate(words):
        letters[row, : len(word)] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    columns = np.ascontiguousarray(letters.T)
    one = np.ones(len(words), np.int8)
    # rows[d]: which asked words are left after d letters beyond the shared ones, and their cells left of, on, and right of the diagonal
    rows = [(np.arange(len(words)), one, np.zeros(len(words), np.int8), one)]
    last, dead = "", None
    for word, _ in scanned:
        if dead is not None and word.startswith(dead):
            continue
        dead, shared = None, half
        most = min(len(word), len(last), half + len(rows) - 1)
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del rows[shared - half + 1 :]
        last = word
        for i in range(shared, len(word)):
            ids, left, on, right = rows[-1]
            x = ord(word[i])
            if i + 1 >= wide + 2:
                dead = word[: i + 1]
                break
            a = np.minimum(left + (columns[i - 1][ids] != x), on + 1)
            b = np.minimum(np.minimum(on + (columns[i][ids] != x), right + 1), a + 1)
            c = np.minimum(right + (columns[i + 1][ids] != x), b + 1)
            live = np.flatnonzero((a <= 1) | (b <= 1) | (c <= 1))
            if not len(live):
                dead = word[: i + 1]
                break
            rows.append((ids[live], a[live].astype(np.int8), b[live].astype(np.int8), c[live].astype(np.int8)))
        if dead is not None:
            continue
        ids, left, on, right = rows[-1]
        over = lengths[ids] - len(word)
        hit = ids[((over == -1) & (left == 1)) | ((over == 0) & (on == 1)) | ((over == 1) & (right == 1))]
        # a pair that agrees at both ends counts in the forward list alone
        near = [k for k in hit.tolist() if min(len(words[k]), len(word)) // 2 == half and not (back and words[k][-half:] == word[-half:])]
        if near:
            best = min((-asked[k][1], words[k][::-1] if back else words[k]) for k in near)
            yield (word[::-1] if back else word), len(near), -best[0], best[1]


def near_words(words: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """``(word, n_near, top)``: how many words are one edit from each word, and the most frequent one as ``{minus, word}``; words without any are absent."""

    def batch(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "n", "best"])

    def run(batches):
        now, scanned, asked, out = None, [], [], []
        for part in batches:
            for name, half, back, key, n, is_scanned, is_asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (name, half, back) != now:
                    if scanned and asked:
                        out += scan(*now[1:], scanned, asked)
                    now, scanned, asked = (name, half, back), [], []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                if is_scanned:
                    scanned.append((key, n))
                if is_asked:
                    asked.append((key, n))
        if scanned and asked:
            out += scan(*now[1:], scanned, asked)
        if out:
            yield batch(out)

    filed = lists(words, least, block)
    dealt = filed.repartition("list").sortWithinPartitions("list", "key").select("list", "half", "back", "key", "n", "scanned", "asked")
    found = dealt.mapInArrow(run, "word string, near long, n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("best").alias("word"))).alias("top"))


def variants(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5, modulus: int = 199, block: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: the vocabulary of all texts, each word with the far more frequent word that it is one edit from.

    ``form`` is the near word of the largest ``n`` (of equals the smallest in code-point order), if that is at least ``times`` times
    the word's own; ``root`` is the end of the way from form to form, the word itself without one. Null and empty texts add
    nothing, repeated rows count as often as they occur, an empty table gives an empty result; columns but ``doc_id`` and ``text`` aren't read.
    """
    if times < 2:
        raise ValueError("times under 2 could lead in a circle")
    words = written(words_of(docs, least, modulus).where(F.col("n") >= often))
    near = near_words(words, least, block)
    form = F.when(-F.col("top.minus") >= times * F.col("n"), F.col("top.word"))
    found = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("top.minus")).alias("form_n")))
    ways = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = written(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(ways)
        ways = far.select("word", "root")
        if not far.where("moved").limit(1).count():
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
