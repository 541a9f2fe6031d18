"""Mixing sources to target weights: exponential keys scaled by quality, and budgets of words met by prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import uniform
from ..operators.ranks import numbered, running_total
from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a source's row in the join with its documents, so that a hot source's documents meet it in many tasks.
SALTS = 64
#: The weight of a document whose own is missing or not positive.
LEAST_WEIGHT = 1e-6


def source_targets(sizes: DataFrame, shares: list[int], most: int = 3) -> DataFrame:
    """``sizes(source, size)``, one row a source, with ``place, share, cap, before, target``.

    Sources are ordered by code point, null last, and get the shares in turn.
    All words are dealt by share, none beyond ``most`` times a source's size;
    what is over goes to the rest by share. In order of cap to share, the
    sources up to some place are at their cap, and that place is where what is
    left, dealt to the rest, first fits: two running totals find it, so
    no round of dealing is repeated. ``before`` is the size of all sources
    before this one. Sources without a word have the target 0; an empty table
    gives an empty one.
    """
    cycle = F.array(*map(F.lit, shares))
    placed = numbered(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], "nth").withColumn("place", F.col("nth") - 1)
    placed = placed.withColumn("share", F.get(cycle, (F.col("place") % len(shares)).cast("int")).cast("long")).withColumn("cap", most * F.col("size"))
    placed = written(placed.withColumn("fill", F.col("cap") / F.col("share")).drop("nth"))
    total, all_shares = placed.agg(F.sum("size"), F.sum("share")).first()
    if total is None:
        return placed.select("none", "source", "size", "place", "share", "cap", F.lit(0).cast("long").alias("before"), F.lit(0.0).alias("target"))
    order = ["fill", "place"]
    capped = running_total(placed.select(*order, "cap", "share"), order, "cap", "caps")
    both = running_total(capped, order, "share", "upto")
    rest, others = F.lit(total) - (F.col("caps") - F.col("cap")), F.lit(all_shares) - (F.col("upto") - F.col("share"))
    fits = both.withColumn("rest", rest).withColumn("others", others).where(F.col("rest").cast("double") * F.col("share") <= F.col("cap").cast("double") * F.col("others"))
    at = fits.agg(F.min(F.struct(*order, "rest", "others"))).first()[0]
    sums = running_total(placed.drop("fill"), ["place"], "size", "upto")
    dealt = F.lit(float(at["rest"])) * F.col("share") / F.lit(float(at["others"]))
    return sums.withColumn("before", F.col("upto") - F.col("size")).withColumn("target", F.least(F.col("cap").cast("double"), dealt)).drop("upto")


def mixture(docs: DataFrame, weights: DataFrame, shares: list[int], most: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, source, size, weight, source_size, target, taken)``: how many words of each document a mix of all sources takes.

    A source takes whole epochs first, then documents in the order of their keys
    -ln(u) / weight (Efraimidis and Spirakis), as long as the middle of a document's words
    lies within what is left of its target; so a source misses its target by half of one document at most.
    No document is taken more than ``most`` times. ``u`` comes from seed and id,
    so reruns agree; rows with equal keys go by id and size, and rows that are equal in these are alike.

    ``weights(doc_id, weight)`` has one row an id at most; a document without one weighs 1, and a
    weight that is not positive counts as ``LEAST_WEIGHT``. Null and empty texts have no words and are taken 0 times; a null source is a
    source; an empty table gives an empty result. Words are counted in the scan: only ids and sizes are
    shuffled, into ranges of (source, key) that split a source of any size.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", F.col("source").isNull().alias("none"), size.alias("size"), F.monotonically_increasing_id().alias("nth"))
    rows = written(rows)
    known = weights.select(F.col("doc_id").alias("_of"), F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(LEAST_WEIGHT).alias("weight"))
    u = uniform(seed, "mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.join(known, F.col("doc_id") == F.col("_of"), "left").drop("_of").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = written(rows.withColumn("key", -F.ln(1 - u) / F.col("weight")))
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("size")))
    targets = source_targets(sizes, shares, most)
    upto = running_total(rows, ["none", "source", "key", "doc_id", "size", "nth"], "size", "upto")
    epochs = F.coalesce(F.floor(F.try_divide("target", F.col("size"))), F.lit(0))
    lots = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    each = targets.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "before", epochs.alias("epochs"), lots.alias("of_lot"))
    met = upto.withColumn("lot", (F.col("nth") % SALTS).cast("int")).join(each, F.col("source").eqNullSafe(F.col("of")) & (F.col("lot") == F.col("of_lot")))
    inside = F.col("upto") - F.col("size") - F.col("before")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    taken = F.col("size") * (F.col("epochs") + (2.0 * inside + F.col("size") <= 2.0 * left).cast("long"))
    return met.select("doc_id", "source", "size", "weight", "source_size", "target", taken.alias("taken"))


def weights_of_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, weight)``, written: from 0.5 to 2 by the mean of a document's quality labels, 1 if all are null."""
    means = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(0.5 + 1.5 * F.avg("quality"), F.lit(1.0)).alias("weight"))
    return written(means)


def oracle(shares: list[int], most: int = 3, seed: int = 42) -> str:
    """DuckDB SQL for ``mixture`` of the given documents, weighted by their labels."""
    return rf"""WITH lab AS (SELECT doc_id, 0.5e0 + 1.5e0 * avg(quality) AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    docs AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS size, coalesce(w, 1e0) AS weight,
        -ln(1e0 - cast(('0x' || substr(md5('{seed}:mix:' || coalesce(d.doc_id::varchar, '')), 1, 13)) AS bigint) / 4503599627370496e0) / coalesce(w, 1e0) AS k FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id),
    src AS (SELECT source, sum(size)::bigint AS s, {most} * sum(size)::bigint AS cap, {list(shares)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(shares)} + 1)::int] AS share, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
    run AS (SELECT *, sum(s) OVER () - (sum(cap) OVER o - cap) AS rest, sum(share) OVER () - (sum(share) OVER o - share) AS others FROM src WINDOW o AS (ORDER BY cap / share, place)),
    fit AS (SELECT rest::double AS rest, others::double AS others FROM run WHERE rest::double * share <= cap::double * others ORDER BY cap / share, place LIMIT 1),
    goal AS (SELECT source, s, least(cap::double, fit.rest * share / fit.others) AS target FROM run, fit),
    each AS (SELECT doc_id, size, s, target, coalesce(floor(target / nullif(s, 0)), 0) AS epochs, sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS inside FROM docs JOIN goal ON docs.source IS NOT DISTINCT FROM goal.source)
    SELECT doc_id, size, s::bigint AS source_size, target, (size * (epochs + (2e0 * inside + size <= 2e0 * (target - epochs * s))::int))::bigint AS taken FROM each"""
