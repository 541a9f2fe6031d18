"""Telephony audio columns: mu-law, A-law and block ADPCM, decoded with numpy over many rows at once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

# Step sizes and index changes of IMA ADPCM, and format tags of wave files.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}

BLOCK = 64
RATE = 8000
#: How stored sound is compressed: without loss.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte."""
    code = np.arange(256) ^ 0x55
    step, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, low + 264 << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA blocks, ``(blocks, 1 + 2 * (bytes - 4))``; the loop goes over positions, not blocks."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((codes.shape[1] + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(np.ascontiguousarray(codes.T)):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def resampled(pcm: np.ndarray, ends: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of samples at another rate, and their new ends.

    To a higher rate: straight lines between samples, the last one repeated; to
    a lower one: means of the samples that fall to each new one. Rounded down.
    """
    up, down = Fraction(rate, RATE).as_integer_ratio()
    starts = np.append(0, ends[:-1])
    counts = (ends - starts) * up // down
    stops = counts.cumsum()
    k = np.arange(stops[-1]) - np.repeat(stops - counts, counts)
    base = np.repeat(starts, counts)
    low = base + k * down // up
    if up >= down:
        high = np.minimum(low + 1, np.repeat(ends, counts) - 1)
        part = k * down % up
        return ((pcm[low].astype(np.int64) * (up - part) + pcm[high].astype(np.int64) * part) // up).astype(np.int16), stops
    high = np.maximum(base + (k + 1) * down // up, low + 1)
    sums = np.append(0, pcm.cumsum(dtype=np.int64))
    return ((sums[high] - sums[low]) // (high - low)).astype(np.int16), stops


def padded(data: bytes) -> bytes:
    """The bytes, with zeros up to a positive multiple of the block."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def wave(payload: bytes, codec: str) -> bytes:
    """A wave file of one channel whose data are the payload, byte for byte."""
    per_block, samples = (BLOCK, 2 * BLOCK - 7) if codec == "adpcm" else (1, 1)
    head = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE * per_block // samples, per_block, 4 if codec == "adpcm" else 8, 2 * (codec == "adpcm"))
    head += struct.pack("<H", samples) if codec == "adpcm" else b""
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, len(payload) // per_block * samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def payload_of(media: bytes) -> tuple[str, bytes]:
    """Codec and data of a wave file, found by walking its chunks."""
    at, codec = 12, ""
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decoded(codec: str, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of many payloads in one array, and where each one ends."""
    sizes = np.array([len(p) for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    if codec == "adpcm":
        return adpcm_samples(flat.reshape(-1, BLOCK)).ravel(), np.cumsum(sizes // BLOCK * (2 * BLOCK - 7))
    return (MULAW if codec == "mulaw" else ALAW)[flat], np.cumsum(sizes)


def features(pcm: np.ndarray, ends: np.ndarray) -> list[str]:
    """Of each row: samples, peak, mean magnitude, root of the mean square, sign changes. Whole numbers."""
    starts = np.append(0, ends[:-1])
    size, wide = ends - starts, pcm.astype(np.int64)
    magnitude = np.abs(wide)
    peak, total, power = np.maximum.reduceat(magnitude, starts), np.add.reduceat(magnitude, starts), np.add.reduceat(wide * wide, starts)
    turn = np.append(0, (pcm[1:] < 0) != (pcm[:-1] < 0)).astype(np.int64)
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts)
    root = np.floor(np.sqrt(power // size)).astype(np.int64)
    return [f"n={n},peak={p},mean={t // n},rms={r},turns={z}" for n, p, t, r, z in zip(size.tolist(), peak.tolist(), total.tolist(), root.tolist(), turns.tolist(), strict=True)]


def stored(rows: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", bytes_col: str = "bytes") -> DataFrame:
    """``(id, n_bytes, media)``: each row's bytes, padded, as wave files of 8-bit telephony codes, written to the shared folder.

    Null bytes count as empty and become one block of zeros. Repeated rows and
    null ids stay as they are, an empty table gives an empty one, other columns aren't read.
    """

    def run(batch):
        data = [b or b"" for b in batch["data"]]
        return {"key": batch["key"], "n_bytes": [len(b) for b in data], "media": [wave(padded(b), codec) for b in data]}

    schema = f"key {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary"
    out = map_batches(rows.select(F.col(id_col).alias("key"), F.col(bytes_col).alias("data")), run, schema)
    return written(out.withColumnRenamed("key", id_col), **PACKED)


def heard(pcm: np.ndarray, ends: np.ndarray, rate: int) -> list[bytes]:
    """Each row's samples at another rate, as little-endian 16-bit PCM."""
    out, stops = resampled(pcm, ends, rate)
    data, at = out.astype("<i2").tobytes(), [0, *(stops * 2).tolist()]
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def between(even: np.ndarray, n: int) -> np.ndarray:
    """Of the first ``n`` places between samples, the mean of both neighbours, rounded down; a missing one is as the one before."""
    wide = even.astype(np.int32)
    return wide[:n] + np.append(wide[1:], wide[-1:])[:n] >> 1


def packed(pcm: bytes) -> bytes:
    """16-bit PCM as its samples at even places, then the others less the mean of their neighbours: as many bytes, from which any PCM comes back.

    As in sound files without loss: what neighbours foretell compresses to nothing.
    """
    samples = np.frombuffer(pcm, "<i2")
    even, odd = samples[::2], samples[1::2]
    return even.tobytes() + (odd - between(even, len(odd))).astype("<i2").tobytes()


def unpacked(data: bytes) -> bytes:
    """The PCM that was ``packed``."""
    samples = np.frombuffer(data, "<i2")
    n = len(samples) // 2
    even, rest = samples[: len(samples) - n], samples[len(samples) - n :]
    out = np.empty(len(samples), "<i2")
    out[::2], out[1::2] = even, (rest + between(even, n)).astype("<i2")
    return out.tobytes()


def pcm_columns(media: DataFrame, rate: int = 16000, id_col: str = "doc_id", store: bool = True) -> DataFrame:
    """``media`` read back, with digests of what it holds and its sound as PCM of ``rate``, written to the shared folder (``packed``) and read back, or with ``store`` False computed where it is read.

    Adds ``codec, pcm, rate, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, others`` and drops ``media``; ``others`` has
    the features of the same payload under the codecs that it wasn't stored as.
    Rows come out as they went in: repeated ones and null ids too. An empty payload is 64 bytes of padding; an empty table gives an empty result;
    a long payload is one value, read in lots bounded by bytes.
    """

    def run(batch):
        read = [payload_of(m) for m in batch["media"]]
        payloads = [p for _, p in read]
        pcm: list[bytes] = [b""] * len(read)
        for codec in {c for c, _ in read}:
            at = [i for i, (c, _) in enumerate(read) if c == codec]
            for i, sound in zip(at, heard(*decoded(codec, [payloads[i] for i in at]), rate), strict=True):
                pcm[i] = sound
        said = {codec: features(*decoded(codec, payloads)) for codec in TAGS}
        return {
            "key": batch["key"],
            "n_bytes": batch["n_bytes"],
            "codec": [c for c, _ in read],
            "rate": [rate] * len(read),
            "pcm": list(map(packed, pcm)) if store else pcm,
            "payload_bytes": [len(p) for p in payloads],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": [zlib.crc32(p[-BLOCK:]) for p in payloads],
            "media_bytes": [len(m) for m in batch["media"]],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in batch["media"]],
            "others": [";".join(f"{k}:{v[i]}" for k, v in said.items() if k != c) for i, (c, _) in enumerate(read)],
        }

    schema = f"key {media.schema[id_col].dataType.simpleString()}, n_bytes long, codec string, rate int, pcm binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, others string"
    out = map_batches(media.select(F.col(id_col).alias("key"), "n_bytes", "media"), run, schema)
    if store:
        out = map_batches(written(out, **PACKED), lambda batch: batch | {"pcm": list(map(unpacked, batch["pcm"]))}, schema)
    return out.withColumnRenamed("key", id_col)


def media_digests(sounds: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pcm_columns``, read back if they are stored, with features of the PCM instead of the samples. Equal bytes give equal values.

    A row each, repeated ones and null ids too; an empty table gives an empty result.
    """

    def run(batch):
        sizes = np.array([len(p) // 2 for p in batch["pcm"]])
        said = features(np.frombuffer(b"".join(batch["pcm"]), "<i2"), sizes.cumsum())
        return {c: batch[c] for c in names} | {"feature": [f"{c}@{r}:{f};{o}" for c, r, f, o in zip(batch["codec"], batch["rate"], said, batch["others"], strict=True)]}

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    schema = f"key {sounds.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(sounds.withColumnRenamed(id_col, "key").select(*names, "codec", "rate", "pcm", "others"), run, schema).withColumnRenamed("key", id_col)
