"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KEPT, map_batches, row_key, sole, written

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons lb lbs oz ml l liter liters litre litres gal gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz v volt volts w kw watt watts j kj kcal cal "
    "pa kpa bar psi k c f degree degrees percent usd eur gbp dollar dollars euro euros cent cents mph kmh".split()
)
STOPS = frozenset(".!?:\n")
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
WIDTH = 8
BITS = 24  # of the filter over window hashes: 2 MB, whatever the benchmark's size
PRIME = np.uint64(0x9E3779B97F4A7C15)


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        value = xxhash.xxh3_64_intdigest(token.encode("utf-8"))
        if len(token) <= 64:
            self[token] = value
        return value


_tokens = TokenHashes()


def canonical(text: str | None) -> tuple[list[str], dict[int, str]]:
    """Tokens with typed placeholders, and the value of each placeholder by its position.

    Numbers, units after a number, and capitalised words that don't begin a
    sentence become placeholders; other words are put in lower case.
    """
    out: list[str] = []
    values: dict[int, str] = {}
    begins = True
    for token in TOKEN.findall(text or ""):
        if token in STOPS:
            begins = True
            continue
        kind = ""
        if token[0].isdigit():
            kind = NUMBER
        elif out and out[-1] == NUMBER and token.lower() in UNITS:
            kind = UNIT
        elif not begins and token[0].isupper() and not token.isupper():
            kind = NAME
        if kind:
            values[len(out)] = token
        out.append(kind or token.lower())
        begins = False
    return out, values


def rolled(tokens: list[str], width: int) -> np.ndarray:
    """Hash of each window of ``width`` tokens."""
    n = len(tokens) - width + 1
    sole(_tokens)
    if len(_tokens) > MOST_KEPT:
        _tokens.clear()
    hashes = np.fromiter(map(_tokens.__getitem__, tokens), np.uint64, len(tokens))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * PRIME + hashes[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(tokens: list[str], values: dict[int, str], width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` tokens, and which windows are literal.

    A window with fewer than ``least`` tokens that are no placeholder says nothing by its template, since any numbers or names fit it:
    it is literal, its hash is that of its own values.
    """
    n = len(tokens) - width + 1
    if n <= 0 or not width:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = rolled(tokens, width)
    free = np.zeros(len(tokens) + 1, np.int64)
    free[[k + 1 for k in values]] = 1
    np.cumsum(free, out=free)
    within = free[width:] - free[:n]
    literal = (within > 0) & (width - within < least)
    if literal.any():
        own = rolled([values.get(k, token) for k, token in enumerate(tokens)], width)
        out[literal] = ~own[literal]
    return out, literal


def windows_of(text: str | None, width: int, least: int) -> tuple[int, list[dict]]:
    """An item's width of windows, and its windows ``hash, at, slots``."""
    tokens, values = canonical(text)
    size = min(width, len(tokens))
    hashes, literal = window_hashes(tokens, values, size, least)
    return size, [{"hash": h, "at": k, "slots": [] if plain else slot_values(values, k, size)} for k, (h, plain) in enumerate(zip(hashes.view(np.int64).tolist(), literal.tolist(), strict=True))]


def slot_values(values: dict[int, str], at: int, width: int) -> list[str]:
    return [values[k] for k in range(at, at + width) if k in values] if values else []


def mapped(window: dict, mapping: dict[str, str]) -> bool:
    """Add the pairs of one window to the mapping; False, and no change, if they break it."""
    new: dict[str, str] = {}
    for pair in window["pairs"]:
        if mapping.get(pair["a"], new.setdefault(pair["a"], pair["b"])) != pair["b"] or new[pair["a"]] != pair["b"]:
            return False
    mapping |= new
    return True


def consistent(windows: list[dict]) -> list[dict]:
    """The windows of one alignment that count.

    The longest run of consecutive windows in which each value of the item has
    one value in the document gives the mapping; other windows count if they
    keep to it, and windows with equal values always do.
    """
    windows = sorted(windows, key=lambda w: (w["at"], [(p["a"], p["b"]) for p in w["pairs"]]))
    best: tuple[int, dict[str, str]] = (0, {})
    for start in range(len(windows)):
        if len(windows) - start <= best[0]:
            break
        mapping: dict[str, str] = {}
        end = start
        while end < len(windows) and (end == start or windows[end]["at"] <= windows[end - 1]["at"] + 1) and mapped(windows[end], mapping):
            end += 1
        if end - start > best[0]:
            best = end - start, mapping
    mapping = best[1]
    return [w for w in windows if all(p["a"] == p["b"] for p in w["pairs"]) or best[0] and mapped(w, mapping)]


WINDOW = "hash long, at int, slots array<string>"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, least: int = 3) -> DataFrame:
    """``(item, width, n_windows, hash, at, slots)``: the template windows of each item, written once.

    An item shorter than a window is one window of its own length; null and
    empty items have none.
    """

    def run(batch):
        out = {name: [] for name in ("item", "width", "n_windows", "found")}
        for item, text in zip(batch["item"], batch["text"], strict=True):
            size, found = windows_of(text, width, least)
            out["item"].append(item)
            out["width"].append(size)
            out["n_windows"].append(len(found))
            out["found"].append(found)
        return out

    items = map_batches(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), run, f"item string, width int, n_windows int, found array<struct<{WINDOW.replace('hash long', 'hash:bigint').replace('at int', 'at:int').replace('slots ', 'slots:')}>>")
    return written(items.select("item", "width", "n_windows", F.inline("found")))


def bit_filter(windows: DataFrame) -> np.ndarray:
    """A bit for each hash's low bits, gathered as words from all windows; its size is fixed."""
    low = F.col("hash").bitwiseAND((1 << BITS) - 1)
    words = windows.groupBy(F.shiftright(low, 5).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(hash & 31 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), "<u4")
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.5, run_windows: int = 6, least_words: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(key, id, contaminated, n_items, items, coverage, reparameterised)`` for each row of ``docs``.

    Documents and items become templates; windows of ``width`` tokens meet in a
    hash join. Windows of one alignment count if their slots are consistent (see
    ``consistent``): each value of the item stands for one value in the document.
    A window with fewer than ``least_words`` tokens that are no placeholder meets only windows of its own values
    (``window_hashes``), so that tables of other numbers have nothing in common with a numeric item.
    An item of one window needs ``least_words`` tokens.
    A document is contaminated by an item if ``share`` of the item's windows are
    found, or ``run_windows`` of them (six windows of eight tokens: thirteen
    tokens in a row). ``reparameterised`` says that a slot's value was changed.

    Only windows that a filter of fixed size lets through leave the scan, so
    texts are not shuffled; the filter never drops a window of the benchmark.
    A window that a third of all documents have is a hot key of an ordinary
    join, which Spark splits. Null and empty texts are clean; rows equal in id
    and text share a verdict; an empty benchmark leaves all clean; items with
    equal ids count as one.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, width, least_words)
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # width at most
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(windows))

    def scan(batch):
        bits, found = shared.value, []
        for text in batch["text"]:
            tokens, values = canonical(text)
            rows = []
            for size in widths:
                hashes, literal = window_hashes(tokens, values, size, least_words)
                low = hashes & np.uint64((1 << BITS) - 1)
                hit = np.flatnonzero(bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                seen = set()  # a literal window's values are its hash, so that it counts wherever it stands: once is enough
                for k, h, plain in zip(hit.tolist(), hashes[hit].view(np.int64).tolist(), literal[hit].tolist(), strict=True):
                    if not plain or h not in seen:
                        rows.append({"hash": h, "at": k, "slots": [] if plain else slot_values(values, k, size)})
                    if plain:
                        seen.add(h)
            found.append(rows)
        return {"key": batch["key"], "id": batch["id"], "found": found}

    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = written(map_batches(rows, scan, f"key binary, id {docs.schema[id_col].dataType.simpleString()}, found array<struct<hash:bigint,at:int,slots:array<string>>>"))
    each = scanned.where(F.size("found") > 0).select("key", F.inline("found")).withColumnRenamed("at", "place").withColumnRenamed("slots", "given")
    met = each.join(windows.select("item", "width", "n_windows", "hash", "at", "slots"), "hash").where(F.size("slots") == F.size("given"))
    equal = F.col("slots") == F.col("given")
    met = met.where((F.col("n_windows") > 1) | (F.col("width") >= least_words) & (equal | (F.col("width") - F.size("slots") >= least_words)))
    met = met.select("key", "item", "n_windows", "at", (F.col("place") - F.col("at")).alias("shift"), F.zip_with("slots", "given", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"))
    aligned = met.groupBy("key", "item", "n_windows", "shift").agg(F.collect_set(F.struct("at", "pairs")).alias("windows")).drop("shift")

    def judged(batch):
        kept = [consistent(windows) for windows in batch["windows"]]
        changed = [any(p["a"] != p["b"] for w in windows for p in w["pairs"]) for windows in kept]
        return {name: batch[name] for name in ("key", "item", "n_windows")} | {"at": [[w["at"] for w in windows] for windows in kept], "changed": changed}

    aligned = map_batches(aligned, judged, "key binary, item string, n_windows int, at array<int>, changed boolean").where(F.size("at") > 0)
    by_item = aligned.groupBy("key", "item").agg(F.max("n_windows").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"), F.max("changed").alias("changed"))
    by_item = by_item.where((F.col("found") >= share * F.col("n")) | (F.col("found") >= run_windows))
    leaks = by_item.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"), F.round(F.max(F.least(F.lit(1.0), F.col("found") / F.col("n"))), 6).alias("coverage"), F.max("changed").alias("reparameterised"))
    out = scanned.select("key", "id").join(written(leaks), "key", "left")  # written, so that Spark can split a hot key
    return out.select("key", F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))
