"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_diff, license_scan, mixing, negatives, piece_codec, quality, secret_scan, setsketch, spelling, telephony, templates, token_count, token_files


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.main_text(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "p_content", "p_metadata", "score", "keep")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no repositories; a source's documents of one language stand for one."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are written and read back, and heard at 16 kHz; this sound is written and read back too, and features are of what was read."""
    texts = read(spark, sf_dir, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS bytes")
    return telephony.media_digests(telephony.pcm_columns(telephony.stored(texts, "mulaw"), rate=16000))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SHARES = [5, 2, 1]


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality comes from the table of labels; documents without one weigh 1."""
    weights = mixing.weights_of_labels(read(spark, sf_dir, "labels"))
    return mixing.mixture(read(spark, sf_dir, "documents"), weights, SHARES).select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


FOUND = (op1_page_text, op2_token_counts, op3_license_scan, op4_token_files, op5_quality, op6_secret_scan, op7_telephony, op8_near_duplicates, op9_decontamination, op10_piece_codec, op11_source_mix, op12_spelling_variants, op13_hard_negatives)
QUERIES = {f.__name__: f for f in FOUND}
ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.oracle(),
    "op11_source_mix": mixing.oracle(SHARES),
    "op13_hard_negatives": negatives.ORACLE,
}
