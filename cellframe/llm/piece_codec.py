"""SentencePiece encoding and decoding by exact backtracking."""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEPT, map_batches, sole

SPACE = "▁"
LONGEST_KEPT = 48
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed: kinds of pieces in a model file


def fields(message: bytes):
    """(number, value) of each field of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback and identity normalisation.

    Spaces become the mark U+2581 and one mark is put before a text that isn't
    empty. Pieces of marks alone all have one lowest score, so they join after
    everything else, leftmost first; all other pieces have scores of their own,
    and no piece has a mark after another character. Hence a text falls into
    words that begin with a mark, and runs of marks between them.
    """

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        rules = {}
        with open(path, "rb") as f:
            for field, value in fields(f.read()):
                if field == 1:
                    x = dict(fields(value))
                    self.pieces.append((x.get(1, b"").decode("utf-8"), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
                elif field == 3:
                    rules = dict(fields(value))
        normal = {p: (s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind == NORMAL}
        marks = {len(p): i for p, (_, i) in normal.items() if set(p) == {SPACE}}
        if rules.get(2) or any(k == USER for _, _, k in self.pieces) or any(SPACE in p.lstrip(SPACE) or p.startswith(2 * SPACE) for p in normal if set(p) != {SPACE}):
            raise ValueError("the model normalises texts, has user-defined symbols, or joins words")
        self.marks, self.mark = marks, marks[1]
        self.rank = {p: (-s, i) for p, (s, i) in normal.items() if set(p) != {SPACE} or len(p) == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.text_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(SPACE, " ").encode("utf-8") for p, _, kind in self.pieces]
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        self.alone = re.compile("([^" + re.escape("".join(sorted(joined))) + "])")
        self.joined = joined
        self.found = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            self.found.add_word(p, (len(p) - 1, i))
        self.found.make_automaton()
        self.length = [len(p) for p, _, _ in self.pieces]
        #: The longest token that is a proper prefix of each token, or -1.
        self.shorter = [-1] * len(self.pieces)
        for p, (_, i) in self.rank.items():
            self.shorter[i] = next((self.rank[p[:k]][1] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank), -1)
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.runs: dict[int, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves: join the best-ranked adjacent pair, leftmost first. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging the two tokens' text gives the same two tokens; left is -1 at the start."""
        b = self.pieces[right][0]
        a = [self.pieces[left][0]] if left >= 0 else []
        if len(self.fits) > MOST_KEPT:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self.merged("".join(a) + b) == [*a, b]
        return known

    def backtracked(self, text: str) -> list[int]:
        """Tokens of a text all of whose characters are pieces."""
        n, length, shorter, fits = len(text), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, (less, token) in self.found.iter(text):
            longest[end - less] = token  # of those that start here, longer ones end later
        failed = None  # a bit for each position that no encoding goes through
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + length[token]
            if not (failed and failed[end >> 3] >> (end & 7) & 1):
                fit = fits.get(last << 32 | token)
                if fit or fit is None and self.compatible(last, token):
                    tokens.append(token)
                    if end == n:
                        return tokens
                    at, last = end, token
                    token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()  # the whole text always has an encoding, so there is one
                at -= length[token]
                token, last = shorter[token], tokens[-1] if tokens else -1

    def word(self, text: str) -> tuple[int, ...]:
        """Tokens of a mark and the characters after it, up to the next mark."""
        if (known := self.words.get(text)) is not None:
            return known
        out: list[int] = []
        for k, part in enumerate(self.alone.split(SPACE + text)):
            if k % 2 == 0:
                if part:
                    out += self.backtracked(part)
            elif part in self.rank:
                out.append(self.rank[part][1])
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode("utf-8")]
            else:
                out.append(next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN))
        if len(text) <= LONGEST_KEPT:
            if len(self.words) > MOST_KEPT:
                self.words.clear()
            self.words[text] = tuple(out)
        return tuple(out)

    def run(self, n: int) -> list[int]:
        """Tokens of n marks: equal scores, so the leftmost pair whose joint length is a piece joins first."""
        most = max(self.marks)
        full, n = (n // most - 1, n % most + most) if n >= 2 * most else (0, n)  # a longest piece can't grow
        if n not in self.runs:
            parts = [1] * n
            while (k := next((k for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.marks), None)) is not None:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.runs[n] = [self.marks[p] for p in parts]
        return [self.marks[most]] * full + self.runs[n]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        run, known, extend = 0, self.words, ids.extend
        for word in text.replace(" ", SPACE).split(SPACE):
            if not word:
                run += 1
                continue
            got = known.get(word) or self.word(word)
            if run:
                lone = got[0] == self.mark
                extend(self.run(run + lone))
                got, run = got[lone:], 0
            extend(got)
        if run:
            extend(self.run(run))
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


_loaded: dict[str, PieceCodec] = {}


def codec_of(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    sole(_loaded[path].words, _loaded[path].fits)
    return _loaded[path]


def piece_codes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of each row's whole text, without a shuffle.

    A null text counts as empty and has no ids. Repeated rows and null ids come
    out as they went in; other columns are not read.
    """

    def run(rows):
        codec = codec_of(model)
        ids = [codec.encode(t or "") for t in rows["text"]]
        return {"key": rows["key"], "ids": ids, "decoded": [codec.decode(x) for x in ids]}

    schema = f"key {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"
    out = map_batches(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("key", id_col)


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: what ``piece_codes`` gives, as digests made beside it.

    A null text counts as empty: no tokens, digests of the empty text. Repeated rows and null ids come out as they went in, an empty table gives an
    empty result.
    """

    def run(rows):
        codec, out = codec_of(model), {"key": rows["key"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = codec.encode(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode("ascii")).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
        return out

    schema = f"key {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = map_batches(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("key", id_col)
