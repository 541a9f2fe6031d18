"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEPT, map_batches

#: Fixed: the pre-tokenizer's pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces longer than this are counted anew each time instead of remembered.
LONGEST_KEPT = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def check(spec: dict) -> None:
    """Raise unless a vocabulary file is a byte-level one whose pieces ``PIECES`` finds and whose merges are all that counts."""
    model, first = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and spec.get("normalizer") for t in spec["added_tokens"])
    if not (model.get("type", "BPE") == "BPE" and plain and level and alone and spec.get("normalizer") is None):
        raise ValueError("not a byte-level vocabulary without normalisation, prefixes and suffixes")


class PieceCounts(dict):
    """Tokens of a piece, by piece; computed when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        names = {symbol: i for i, symbol in enumerate(byte_symbols())}
        #: Rank of a pair by its right symbol, by its left one; what the pair of each rank becomes.
        self.ranks: list[dict[int, int]] = [{} for _ in names]
        self.made: list[int] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            made = names.setdefault(left + right, len(names))
            if made == len(self.ranks):
                self.ranks.append({})
            self.made.append(made)
            self.ranks[names[left]].setdefault(names[right], rank)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PIECES)

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= LONGEST_KEPT:
            self[piece] = n
        return n

    def merged(self, symbols: bytes) -> int:
        """Initial symbols minus merges: always merge the lowest-rank adjacent pair, leftmost first."""
        ranks, made, n = self.ranks, self.made, len(symbols)
        symbol, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [rank << 40 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := ranks[a].get(b)) is not None]
        heapq.heapify(heap)
        pop, push, left_over = heapq.heappop, heapq.heappush, n
        while heap:
            entry = pop(heap)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j < 0 or ranks[symbol[i]].get(symbol[j]) != rank:
                continue  # one of the two was merged meanwhile
            left_over -= 1
            new = symbol[i] = made[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks[new].get(symbol[k])) is not None:
                    push(heap, rank << 40 | i)
            h = before[i]
            if h >= 0 and (rank := ranks[symbol[h]].get(new)) is not None:
                push(heap, rank << 40 | h)
        return left_over

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings count one each."""
        parts, extra = [text], 0
        if self.special:
            parts = self.special.split(text)
            extra = len(parts) - 1
        if len(self) > MOST_KEPT:
            self.clear()
        find = self.pattern.findall
        return extra + sum(sum(map(self.__getitem__, find(p))) for p in parts)


_loaded: dict[str, PieceCounts] = {}


def counts_of(path: str) -> PieceCounts:
    if path not in _loaded:
        _loaded[path] = PieceCounts(path)
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each row's whole text, without a shuffle.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can
    open. A null text counts as empty: 0 bytes, 0 tokens. Rows are neither
    joined nor grouped, so repeated rows and null ids come out as they went in;
    other columns are not read. An empty table gives an empty result.
    """
    schema = f"key {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(rows):
        counts, texts = counts_of(vocabulary), [t or "" for t in rows["text"]]
        return {"key": rows["key"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [counts.count(t) for t in texts]}

    out = map_batches(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), run, schema)
    return out.select(F.col("key").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
