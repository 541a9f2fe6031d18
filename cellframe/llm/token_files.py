"""Flat token-id files with 64-bit document offsets."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lots, shared_dir, written

SHARD_BYTES = 256 << 20  # of ids in a shard, about
READ_BYTES = 16 << 20  # of ids read at once

#: Fixed: the parts of a vocabulary file under which a text's words can be told without the library.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same words in texts of printable ASCII and Latin letters to U+00FF, in small letters.
PLAIN, PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ]+"), re.compile("[\n!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")

_loaded: dict[str, object] = {}


def tokenizer_of(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def parts_words(spec: dict) -> bool:
    """Whether a vocabulary file lower-cases texts, drops white space, and merges inside words that ``WORDS`` finds."""
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split, *others = splits or [{}]
    return (
        steps == NORMALIZERS
        and split.get("pattern", {}).get("Regex") == WORDS
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and [(o["type"], o.get("use_regex"), o.get("add_prefix_space")) for o in others] == [("ByteLevel", False, False)]
        and spec.get("post_processor") is None
        and spec["model"].get("end_of_word_suffix") == WORD_END
        and not spec["model"].get("dropout")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not PLAIN_WORDS.fullmatch(t["content"]) for t in spec["added_tokens"])
    )


class TextIds:
    """The ids of texts, as the file's bytes.

    If the vocabulary file says that white space parts words and has no ids
    (``parts_words``), a text's ids are those of its chunks between white space,
    in order; each different chunk of a batch is looked up once, a plain chunk's
    ids are those of its words, and the library sees each new word once. All
    other chunks go to the library as they are. Texts of any other vocabulary
    file go to the library whole.
    """

    MOST = 1_000_000
    LONGEST = 64

    def __init__(self, path: str, kind: str):
        self.tokenizer, self.kind = tokenizer_of(path), kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = parts_words(spec)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Look up words between spaces, some hundred at once; a word's last id is one that ends a word."""
        size = np.dtype(self.kind).itemsize
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            data, stops = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(stops) != len(part):
                raise ValueError("the vocabulary doesn't end words as its file says")
            self.words.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def of_plain(self, chunks: list[str]) -> list[bytes]:
        """The ids of plain chunks, from those of their words; a line end parts the chunks and has no ids."""
        found = PLAIN_WORDS.findall("\n".join(chunks).lower())
        words = self.words
        if len(words) > self.MOST:  # before the new words are told from those that are known
            words.clear()
        words.pop("\n", None)
        self.learn([w for w in dict.fromkeys(found) if w not in words and w != "\n"])
        words["\n"] = b""
        ids = list(map(words.__getitem__, found))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        stops = [*lengths.cumsum()[lengths == 0].tolist(), int(lengths.sum())]
        data = b"".join(ids)
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks, none of which holds ASCII white space."""
        known = self.chunks
        if len(known) > self.MOST:
            known.clear()
        new = [c for c in chunks if c not in known]
        if new:
            every = "\n".join(new)
            special = any(s in every for s in self.special)
            if PLAIN_LINES.fullmatch(every) and not special:
                plain, odd = new, []
            else:
                plain = [c for c in new if PLAIN.fullmatch(c) and not (special and any(s in c for s in self.special))]
                odd = list(set(new).difference(plain))
            got = dict(zip(plain, self.of_plain(plain), strict=True)) if plain else {}
            for lo in range(0, len(odd), 256):
                got |= zip(odd[lo : lo + 256], self.whole(odd[lo : lo + 256]), strict=True)
            if max(map(len, new)) <= self.LONGEST:
                known |= got
            else:
                known.update((c, ids) for c, ids in got.items() if len(c) <= self.LONGEST)
                return [ids if (ids := known.get(c)) is not None else got[c] for c in chunks]
        return list(map(known.__getitem__, chunks))

    def encoded(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text and the end id, as binary."""
        texts = texts.fill_null("")
        if not self.by_word:
            return pa.array([ids + end for ids in self.whole(texts.to_pylist())], pa.binary())
        # a text's chunks, and one more for its end
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        coded = split.flatten().dictionary_encode()
        parts = [*self.of_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
        stops = np.diff(split.offsets.to_numpy()).cumsum()
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), stops, len(parts) - 1)
        size = len(end)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        starts = np.append(0, lengths.cumsum()[:-1])
        n = lengths[order]
        upto = n.cumsum()
        flat = np.frombuffer(b"".join(parts), self.kind)
        ids = flat[np.repeat(starts[order] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = np.append(0, upto[stops + np.arange(len(stops))] * size)
        if offsets[-1] >= 1 << 31:
            raise ValueError("a batch of texts holds over 2 GB of ids; hand over fewer rows at once")
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


_ids: dict[tuple[str, str], TextIds] = {}


def ids_of(path: str, kind: str) -> TextIds:
    if (path, kind) not in _ids:
        _ids[path, kind] = TextIds(path, kind)
    return _ids[path, kind]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address and the path there."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


class Shards:
    """Which shard a row belongs to: how many of the shards' lowest ``(id, tie)`` pairs, but for the first one's, are at or below its own."""

    def __init__(self, lows: list[tuple[int | None, int]]):
        self.count = len(lows) + 1
        self.nulls = [tie for key, tie in lows if key is None]
        self.keys = np.array([key for key, _ in lows if key is not None], np.int64)
        self.ties = [tie for key, tie in lows if key is not None]

    def of(self, keys: pa.Array, ties: np.ndarray) -> np.ndarray:
        plain, none = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.keys, plain, "left"), np.searchsorted(self.keys, plain, "right")
        for k in np.flatnonzero((low < high) & ~none).tolist():  # a shard begins inside the rows of this id
            low[k] = bisect_right(self.ties, ties[k], low[k], high[k])
        out = low + len(self.nulls)
        for k in np.flatnonzero(none).tolist():
            out[k] = bisect_right(self.nulls, ties[k])
        return out


def shards_of(rows: DataFrame, partitions: int | None) -> Shards:
    """Shards of about equally many rows of ``(id, tie, size)``, as many as keep one near ``SHARD_BYTES``; a row of each comes to the driver."""
    n = partitions
    if n is None:
        size = rows.agg(F.sum("size")).first()[0] or 0
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ranges = rows.select("id", "tie").repartitionByRange(n, "id", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "tie")).alias("low"))
    lows = [(r.id, r.tie) for r in ranges.orderBy("part").select("low.*").collect()]
    return Shards(lows[1:])


def kind_of(vocabulary: str, end_id: int) -> str:
    return "<u2" if max(tokenizer_of(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write token ids in ascending id order and return the manifest ``(shard, name, width, n_docs, n_tokens, base)``.

    Shards are ranges of the document id, made from ids and hashes alone; texts
    are encoded where they are read, and ids are what is shuffled. A shard has
    flat little-endian files: ``.ids`` (uint16 if the vocabulary fits, else
    uint32), ``.off`` (uint64 offsets of the shard's documents, one more than
    documents), ``.doc`` (int64 document ids) and ``.nul`` (a byte for each, 1
    where the id is null). ``base`` is the number of ids in all earlier shards,
    a prefix sum over the manifest's few rows.

    A null text gives the end id alone; null ids come first; rows with the same
    id are ordered by a hash of their text, so a third of all rows may share an
    id and still be dealt out. An empty table gives no shard. A task that runs
    again writes files of another name, and the manifest names those of the
    attempt that Spark kept; files of lost attempts are never read.
    """
    bounded_batches(docs.sparkSession)
    kind = kind_of(vocabulary, end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    shards = shards_of(rows.select("id", "tie", F.octet_length("text").alias("size")), partitions)

    def encode(batches):
        ids, end = ids_of(vocabulary, kind), np.array([end_id], kind).tobytes()
        for batch in batches:
            for lot in lots(batch, 2048):
                part = shards.of(lot.column(0), lot.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), lot.column(0), lot.column(1), ids.encoded(lot.column(2).cast(pa.string()), end)], names=["part", "id", "tie", "ids"])

    dealt = rows.mapInArrow(encode, "part int, id long, tie long, ids binary").repartitionById(shards.count, "part").sortWithinPartitions("id", "tie").select("id", "ids")

    def write(batches):
        store, at = opened(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        files, docs, total = {}, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                store.create_dir(at)
                files = {x: store.open_output_stream(f"{at}/{name}.{x}") for x in ("ids", "off", "doc", "nul")}
                files["off"].write(np.zeros(1, "<u8").tobytes())
            keys, ids = batch.column(0), batch.column(1)
            offsets = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4).astype(np.int64)
            files["ids"].write(ids.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]))
            files["off"].write(((offsets[1:] - offsets[0]) // int(kind[-1]) + total).astype("<u8").tobytes())
            files["doc"].write(keys.fill_null(0).to_numpy().astype("<i8").tobytes())
            files["nul"].write(keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            docs, total = docs + len(ids), total + int(offsets[-1] - offsets[0]) // int(kind[-1])
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "width": pa.array([int(kind[-1])], pa.int32()), "n_docs": [docs], "n_tokens": [total]})

    manifest = written(dealt.mapInArrow(write, "shard int, name string, width int, n_docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Numbers:
    """A file of numbers: memory-mapped where the store is a local one, else read by ranges."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str):
        self.kind, self.width, self.file, self.map = kind, np.dtype(kind).itemsize, None, None
        if isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return self.map[part]
        return np.frombuffer(self.file.read_at((part.stop - part.start) * self.width, part.start * self.width), self.kind)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document, from the files alone.

    ``start`` counts the ids of all documents before it; the checksum is of the
    ids as little-endian unsigned 32-bit integers, the end id among them. Of a
    shard some thousand documents are held at once, and some MB of their ids or one document's.
    Documents that had a null or empty text have their end id alone; repeated rows and null ids are read as they were written; files of an empty
    table give an empty result.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        store, at = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc, nul = (Numbers(store, f"{at}/{row['name']}.{x}", k) for x, k in (("ids", f"<u{row['width']}"), ("off", "<u8"), ("doc", "<i8"), ("nul", "u1")))
                for lo in range(0, row["n_docs"], 4096):
                    hi = min(lo + 4096, row["n_docs"])
                    ends = off[lo : hi + 1].astype(np.int64)
                    crc, k = [], 0
                    while k < hi - lo:
                        j = max(k + 1, int(np.searchsorted(ends, ends[k] + READ_BYTES // row["width"], "right")) - 1)
                        part = memoryview(ids[int(ends[k]) : int(ends[j])].astype("<u4")).cast("B")
                        at4 = ((ends[k : j + 1] - ends[k]) * 4).tolist()
                        crc += [zlib.crc32(part[a:b]) for a, b in zip(at4, at4[1:], strict=False)]
                        k = j
                    yield pa.RecordBatch.from_pydict({"key": pa.array(doc[lo:hi], mask=nul[lo:hi] > 0), "start": ends[:-1] + row["base"], "n_tokens": np.diff(ends), "ids_crc32": pa.array(crc, pa.int64())})

    out = manifest.repartition(n, "shard").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.col("key").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new folder of token files and read them back."""
    folder = shared_dir(docs.sparkSession)
    return read_token_files(docs.sparkSession, write_token_files(docs, folder, vocabulary, end_id), folder)
