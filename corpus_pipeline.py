"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import piece_codec, quality, secret_scan, templates
from cellframe.llm.common import row_key, shared_dir, written
from cellframe.llm.setsketch import clusters


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps. Null and empty texts are scored as any other; without labels all stay.

    Columns named like the classifier's own keep their values: they bear other names while it scores.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: f"own {k} {c}" for k, c in enumerate(docs.columns) if c.lower() in quality.ADDED}
    kept = quality.scored(docs.withColumnsRenamed(own), model).where("keep")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id, and of equal ids the text with the smallest hash.

    Rows with a null id or without words are in no component and stay. Of rows
    that are equal in id and text one stays; only their texts are shuffled.
    """
    found = written(clusters(docs, width=5, percent=80))
    key = [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie")]
    rows = docs.select(F.struct("*").alias("row"), *key)
    # how many rows go follows the corpus, so that texts meet them by a shuffle at every size
    rest = rows.join(written(found.where("NOT best").select("id", "tie").distinct()).hint("merge"), ["id", "tie"], "left_anti")
    again = written(found.where("best AND id IS NOT NULL AND n_shingles > 0").groupBy("id", "tie").count().where("count > 1").select("id", "tie"))
    if again.limit(1).count():
        one = rest.join(again, ["id", "tie"]).groupBy("id", "tie").agg(F.first("row").alias("row")).select("row", "id", "tie")
        rest = rest.join(again, ["id", "tie"], "left_anti").select("row", "id", "tie").unionByName(one)
    return rest.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; with an empty benchmark all stay."""
    found = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = written(found.where("contaminated").select("key").distinct())
    return docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key")).join(leaks, "key", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced. Null texts stay null; a null source counts as one owner."""
    return secret_scan.redacted(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's piece ids and of the text decoded from them; a null text counts as empty."""
    return piece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]
#: A classifier's fit and a sketch are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
