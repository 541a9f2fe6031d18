"""Main text of web pages by nearest-URL page differencing."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^>"'])*+|[^>]*)(?:>|\Z)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
HEADING = 10
PARTS = re.compile("[-_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset(["article", "main"])
#: Elements that no class leaves out.
WHOLE = MAIN | {"html", "body"}
#: Elements, and whole words of a class, id or role, that hold no main text.
AROUND = frozenset("nav footer aside form button dialog menu head fieldset".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar notice cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments disqus reply replies respond contentinfo complementary".split()
)

LAYOUT = frozenset("main site page post top bottom left right primary secondary global local list area section wrapper wrap container box block bar inner outer links slot unit widget item".split())


def left_out(tag: str, attributes: str) -> bool:
    if tag in AROUND:
        return True
    return bool(attributes) and tag not in WHOLE and any(named_around(word) for m in NAMED.findall(attributes) for word in m.strip("\"'").lower().split())


def named_around(word: str) -> bool:
    """Whether a class word is one of ``NAMES``, or made of them and of layout words: ``main-nav``, ``comments_list``, not ``no-sidebar``."""
    parts = PARTS.split(word)
    return word in NAMES or any(p in NAMES for p in parts) and all(p in NAMES or p in LAYOUT for p in parts)


def blocks(page: str) -> list[tuple[str, int]]:
    """``(line, place)`` of each block in page order; place 3: in an article, 2: in the main element, 1: elsewhere, 0: left out by its element; less by 10: a heading.

    Inline elements stay inside their block, all others and line breaks end it. A heading is a line of an h1 or h2
    element, or one that equals the page's title.
    """
    title = TITLE.search(page)
    named = " ".join(html.unescape(title[1]).split()) if title else ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open block elements and their place
    place, at, parts = 1, 0, []

    def flush() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                heading = line == named or any(t in ("h1", "h2") for t, _ in stack)
                out.append((line, place - HEADING if heading else place))
            parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in INLINE and not (tag == "span" and m["attributes"] and left_out(tag, m["attributes"])):
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                place = stack[-1][1] if stack else 1
            continue
        if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next one begins
            stack.pop()
            place = stack[-1][1] if stack else 1
        if place and (left_out(tag, m["attributes"]) or tag == "header" and place == 1):
            place = 0
        elif 0 < place < 3 and tag in MAIN:
            place = 3 if tag == "article" else 2
        stack.append((tag, place))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def rows_of(a: list[int], b: list[int]):
    """Bit-parallel rows of the longest common subsequence: at first and after each line of ``a``, bit j is 0 where the length grows at ``b[j]``.

    A line's places are turned into bits when it is met, so that no more than a few rows are held.
    """
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    full = (1 << len(b)) - 1
    row = full
    yield row
    for x in a:
        bits = bytearray(len(b) // 8 + 1)
        for j in places.get(x, ()):
            bits[j >> 3] |= 1 << (j & 7)
        match = row & int.from_bytes(bits, "little")
        row = (row + match | row - match) & full
        yield row


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest common subsequence's length of ``a`` with each beginning of ``b``; one row is held at a time."""
    row = 0
    for row in rows_of(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


#: Product of line counts up to which all rows are held: 8 MB of bits.
HELD = 1 << 26


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of both.

    Equal lines at both ends count at once, lines that the other list doesn't have are dropped. What is left is
    aligned by bit-parallel rows, halved until its rows fit ``HELD`` bits (Hirschberg): memory follows the lines, not their product.
    """
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    inner_a, inner_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    in_a, in_b = set(inner_a), set(inner_b)
    kept = [k for k, x in enumerate(inner_a, lo) if x in in_b]
    work = [([a[k] for k in kept], [x for x in inner_b if x in in_a], kept)]
    out = []
    while work:
        left, right, places = work.pop()
        if not left or not right:
            continue
        if len(left) * len(right) <= HELD or len(left) == 1:
            out += [places[k] for k in aligned(left, right)]
            continue
        half = len(left) // 2
        split = int((lengths(left[:half], right) + lengths(left[half:][::-1], right[::-1])[::-1]).argmax())
        work += [(left[:half], right[:split], places[:half]), (left[half:], right[split:], places[half:])]
    return [*range(lo), *sorted(out), *range(len(a) - hi, len(a))]


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, walked back through rows in which the length grew."""
    rows, last = list(rows_of(a, b)), {x: 0 for x in a}
    for j, x in enumerate(b):
        last[x] = last.get(x, 0) | 1 << j
    kept, width = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        mask = (1 << width) - 1
        zeros = ~rows[i + 1] & mask
        if not zeros:
            break
        if (~rows[i] & mask).bit_count() == zeros.bit_count():
            continue  # as long without a[i]
        kept.append(i)
        width = (last[a[i]] & mask).bit_length() - 1
    return kept[::-1]


def level(place: int) -> int:
    return place + HEADING if place < 0 else place


def main_places(found: list[tuple[str, int]]) -> list[bool]:
    """Which lines may be main text: those of an article or main element, unless lines outside of any hold more; then both."""
    inside, outside = (sum(len(line) for line, place in found if level(place) in p) for p in ((2, 3), (1,)))
    least = 2 if inside and inside >= outside else 1
    return [level(place) >= least for _, place in found]


def outline(found: list[tuple[str, int]]) -> tuple[list[int], list[int], bool]:
    """Of each line a 64-bit hash, and its length if it may be main text (less than 0 for a heading), else 0; and whether main text is that of an article."""
    mine = main_places(found)
    hashes = [xxhash.xxh3_64_intdigest(line.encode("utf-8")) - (1 << 63) for line, _ in found]
    sizes = [(-len(line) if place < 0 else len(line)) if m else 0 for (line, place), m in zip(found, mine, strict=True)]
    return hashes, sizes, all(level(place) == 3 for (_, place), m in zip(found, mine, strict=True) if m)


def same_of(hashes: list[int], sizes: list[int], article: bool) -> bytes:
    """128 bits that pages with equal lines and places share."""
    return xxhash.xxh3_128_digest(np.array([*hashes, *sizes, article], "<i8").tobytes())


def frame_lines(sizes: list[int], article: bool, shared: list[int]) -> list[int]:
    """Which of the shared lines are the site's frame, and go.

    An article element says itself what is its text, so all of its lines stay, also those that the
    neighbour has too. Without one, shared lines go but for the page's own title and headings, unless no other line were left: such
    a page is a reprint, not a frame.
    """
    if article:
        return []
    mine = {i for i, size in enumerate(sizes) if size > 0}
    met = mine.intersection(shared)
    return [] if met == mine else sorted(met)


def flags(gone: list[int], n: int) -> list[bool]:
    """Of each of ``n`` lines whether it goes; empty if none does."""
    out = [False] * n if gone else []
    for i in gone:
        out[i] = True
    return out


def nearest(path: str, before: str | None, after: str | None) -> int:
    """Which neighbour in URL order has the longer common start of the path: -1, 1, or 0 for none."""

    def common(other: str | None) -> int:
        if other is None:
            return -1
        return next((k for k, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))

    left, right = common(before), common(after)
    return 0 if left == right == -1 else -1 if left >= right else 1


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``: the position in the order of all rows, from range partitions and their prefix sums.

    The sort is split over range partitions; only one row of each partition, its
    count, meets in the window that adds up the counts before it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id())
    parts = written(parts)
    part = F.shiftright("slot", 33)  # partition number of monotonically_increasing_id
    counts = parts.groupBy(part.alias("part")).count()
    bases = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = parts.withColumn("part", part).join(F.broadcast(bases), "part")  # a row for each partition, n at most
    return out.withColumn("rank", F.col("base") + F.col("slot").bitwiseAND((1 << 33) - 1)).drop("part", "base", "slot")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars, n_lines, n_shared, n_dropped)`` of each page.

    Pages of a host with equal lines count as one page, at the first of their
    paths; these are put in order of their URL paths. Each one is compared with
    that neighbour whose path begins most like its own, lines aligned by longest
    common subsequence. Outside of an article element, lines that both share are the site's frame and are
    deleted (``frame_lines``); so are, anywhere, elements for menus, footers, sidebars,
    adverts, forms and reader comments. An article or main element holds the main
    text, unless more text stands outside of it. ``n_shared`` counts the page's
    lines that its neighbour has too, wherever they stand, ``n_dropped`` those
    of its main text that were deleted for it.

    Very long pages are aligned in memory that follows their lines; of two neighbours with as long a common start the one before
    counts, and equal paths are in order of their lines' hash. A null or empty page gives an empty text; a null URL counts as empty, so
    those pages form a host of their own; equal pages give equal rows, one for
    each row that came in. A large group of copies is folded before its shuffle,
    and met again by a join that Spark splits. Only hashes of lines are compared and sorted, so a
    host with a third of all pages is spread over many tasks; a page's text is
    shuffled once, to meet what was found for it.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    plain = F.regexp_replace(url, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"(/|\.html?)$", "")

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))

    def hashed(batch):
        found = [outline(blocks(page or "")) for page in batch["html"]]
        return {"host": batch["host"], "path": batch["path"], "same": [same_of(*x) for x in found], "lines": [x[0] for x in found], "sizes": [x[1] for x in found], "article": [x[2] for x in found]}

    light = map_batches(base.select("host", "path", "html"), hashed, "host string, path string, same binary, lines array<long>, sizes array<int>, article boolean")
    once = written(light.groupBy("host", "same").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("lines", "sizes", "article")]))
    order = ranked(once, ["host", "path", "same"])
    near = [order.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"host{name}"), F.col("path").alias(f"path{name}"), F.col("lines").alias(f"lines{name}")) for name, step in (("_a", 1), ("_b", -1))]
    beside = order.join(near[0], "rank", "left").join(near[1], "rank", "left").drop("rank")

    def compared(batch):
        shared, drop = [], []
        for host, path, lines, ha, pa_, la, hb, pb, lb, sizes, article in zip(*(batch[c] for c in ("host", "path", "lines", "host_a", "path_a", "lines_a", "host_b", "path_b", "lines_b", "sizes", "article")), strict=True):
            way = nearest(path, pa_ if ha == host else None, pb if hb == host else None)
            other = la if way < 0 else lb if way > 0 else None
            shared.append(common_lines(lines, other) if other else [])
            drop.append(frame_lines(sizes, article, shared[-1]))
        return {"host": batch["host"], "same": batch["same"], "n_shared": list(map(len, shared)), "n_dropped": list(map(len, drop)), "go": [flags(gone, len(sizes)) for gone, sizes in zip(drop, batch["sizes"], strict=True)]}

    found = written(map_batches(beside, compared, "host string, same binary, n_shared long, n_dropped long, go array<boolean>"))

    def read(batch):
        out = {"id": batch["id"], "url": batch["url"], "host": batch["host"], "same": [], "lines": []}
        for page in batch["html"]:
            got = blocks(page or "")
            out["same"].append(same_of(*outline(got)))
            out["lines"].append([line if mine else None for (line, _), mine in zip(got, main_places(got), strict=True)])
        return out

    texts = map_batches(base.select("id", "url", "html", "host"), read, f"id {pages.schema[id_col].dataType.simpleString()}, url string, host string, same binary, lines array<string>")
    both = texts.join(found.hint("merge"), ["host", "same"], "left")  # alike at every size
    kept = F.filter(F.arrays_zip("lines", "go"), lambda x: x["lines"].isNotNull() & ~F.coalesce(x["go"], F.lit(False)))
    text = F.array_join(F.transform("kept", lambda x: x["lines"]), "\n")
    out = both.withColumn("kept", kept)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("kept").cast("long").alias("n_lines"), "n_shared", "n_dropped")
