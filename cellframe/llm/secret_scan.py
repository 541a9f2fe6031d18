"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, row_key, written

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more among those of [0-9a-f]+
#: Every match of ASSIGN, in small letters, has one of these; the last two are letters that count as an s and an i of either case.
ASSIGN_HAS = ("passw", "secret", "token", "api", "\u017f", "\u0131")
#: Kinds beside the base ones, in order: pattern, the group that holds the credential, and what each match has in small letters.
MORE = [
    ("github", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, ("xox",)),
    ("google", re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0, ("aiza",)),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, ("eyj",)),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+"), 0, ("private key-----",)),
    ("url", re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/@]{6,128})@"), 1, ("://",)),
    ("bearer", re.compile(r"(?i:\bbearer)\x20+([A-Za-z0-9+/_.=-]{20,})"), 1, ("bearer",)),
]
BASE = ("assign", "access", "hex")
KINDS = [*BASE, *(name for name, *_ in MORE)]


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of each span, in order of start and kind.

    A pattern runs over the whole text if the text has any of the strings without which it can't match.
    """
    small = text.lower()
    found = [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if any(x in small for x in ASSIGN_HAS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "akia" in small:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    for k, (_, pattern, group, has) in enumerate(MORE, len(BASE)):
        if any(x in small for x in has):
            found += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text)]
    return sorted(found)


SPAN = "array<struct<start:int,kind:int,stop:int,hash:binary>>"


def scanned(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, id, repo, owner, found)`` for each row: its candidates, with a hash of each credential, no text.

    The table is written once and read for counting and for deciding.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), repository.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"))

    def run(batch):
        found = []
        for text in batch["text"]:
            got = candidates(text or "")
            found.append([{"start": s, "kind": k, "stop": e, "hash": hashlib.sha256(v.encode("utf-8")).digest()[:16]} for s, k, e, v in got])
        return {name: batch[name] for name in ("key", "id", "repo", "owner")} | {"found": found}

    return written(map_batches(rows, run, f"key binary, id {docs.schema[id_col].dataType.simpleString()}, repo string, owner string, found {SPAN}"))


def ownership(scan: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repositories)``: how many distinct owners and repositories show each credential.

    Each hash is first reduced to one row for each repository of each owner,
    before and after the shuffle, so that a credential that a third of all rows
    show is no larger than its list of repositories. Null owners and repositories count as one more each.
    """
    seen = scan.select("owner", "repo", F.explode("found.hash").alias("hash"))
    seen = seen.select("hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    by_owner = seen.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("one").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("owner").alias("n_owners"), F.sum("repos").alias("n_repositories"))


def secret_spans(docs: DataFrame, repository: Column, owner: Column, common_owners: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, id, spans)``: each row's spans with ``n_owners``, ``n_repositories`` and ``live``.

    A credential that ``common_owners`` or more distinct owners show is a copied
    example; one that fewer show looks live. Rows without any span have an empty
    array; a null text counts as empty; rows that are equal in id and text have
    the same spans. An empty table gives an empty result. The counts
    are written before they are joined by credential hash, so that Spark knows
    their size and can split a hot hash.
    Spans are then gathered by row, whose number is bounded by the row's own text.
    """
    scan = scanned(docs, repository, owner, id_col, text_col)
    each = scan.where(F.size("found") > 0).select("key", F.explode("found").alias("span")).select("key", "span", F.col("span.hash").alias("hash"))
    known = each.join(written(ownership(scan)), "hash").select("key", F.struct("span.start", "span.kind", "span.stop", "n_owners", "n_repositories", (F.col("n_owners") < common_owners).alias("live")).alias("span"))
    gathered = known.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    empty = "array<struct<start:int,kind:int,stop:int,n_owners:bigint,n_repositories:bigint,live:boolean>>"
    with_any = scan.where(F.size("found") > 0).select("key", "id").join(written(gathered), "key")
    without = scan.where(F.size("found") == 0).select("key", "id", F.array().cast(empty).alias("spans"))
    return with_any.select("key", "id", F.col("spans").cast(empty).alias("spans")).unionByName(without).withColumnRenamed("id", id_col)


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, repository: Column, owner: Column, common_owners: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digests and span lists of ``secret_spans``, one row for each row of ``docs``.

    A text without spans, null or empty ones too, has counts of 0, the digest of an empty list and empty lists. Repeated rows come out as often as
    they went in; an empty table gives an empty result.
    """
    found = secret_spans(docs, repository, owner, common_owners, id_col, text_col)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    live = F.filter("spans", lambda s: s["live"])
    return found.select(id_col, of(0), of(1), of(2), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), span_text(live).alias("live_spans"), F.coalesce(F.array_max(F.col("spans.n_owners")), F.lit(0)).alias("most_owners"))


def redacted(docs: DataFrame, repository: Column, owner: Column, common_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each live-looking credential's span replaced by a mark; copied examples stay.

    All rows and columns are kept, whatever their names; texts without such
    spans, null ones too, come out as they are. Overlapping spans are joined
    before they are replaced. Rows that are equal in id and text stay as often as they came.
    """
    spans = secret_spans(docs, repository, owner, common_owners, id_col, text_col)
    live = F.filter("spans", lambda s: s["live"])
    hits = spans.where(F.size(live) > 0).select("key", F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("cut")).dropDuplicates(["key"])
    joined = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(hits, "key", "left")
    text = F.col("row")[text_col]
    # spans are in order of start: copy what lies between them
    step = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.col("cut").isNotNull(), step).otherwise(text)
    return joined.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
