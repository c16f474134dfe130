"""The corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring_dedup import remove_repeated_words

    return remove_repeated_words(documents(spark, sf_dir)).drop("n_spans")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import pii_spans

    return pii_spans(documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secret_scan import secret_spans

    return secret_spans(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import simhash_groups

    return simhash_groups(documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.sentencepiece import encodings

    found = encodings(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return found.select("doc_id", "rank", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxh64"), F.sha2("text", 256).alias("text_sha256"), "log_prob", "perturbed", "log_inclusion")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sketch_fingerprint import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.col("text_sha256"))


QUERIES = {
    "op1_suffix_array_dedup": op1,
    "op2_substring_dedup": op2,
    "op3_pii": op3,
    "op4_secret_scan": op4,
    "op5_simhash_near_dedup": op5,
    "op6_sentencepiece": op6,
    "op7_packing": op7,
    "op8_toxicity": op8,
    "op9_document_fingerprints": op9,
    "op10_exact_dedup": op10,
}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
}
