"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe_count, lobpcg, lpt_shards, norm_buckets, packing, pfair, pq_dedup, prefix_doubling, quality, secrets, simhash_bk, stream_dedup, toxicity


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_bk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.simhash_components(table(spark, sf_dir, "documents"))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


#: Target shares of characters; a source that is not named gets the least of them.
MIXTURE = {f"src{i}": 4.0 if i < 5 else 2.0 if i < 10 else 1.0 for i in range(20)}


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return pfair.mix(docs, MIXTURE, size_col="n_chars").select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op9_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_open_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = lobpcg.whiten(table(spark, sf_dir, "embeddings"), components=8)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_prefix_doubling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_doubling.remove_repeats(table(spark, sf_dir, "documents"))


def op13_norm_bucket_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return norm_buckets.mine_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pq_near_vectors,
        op2_lpt_shards,
        op3_linked_secrets,
        op4_bradley_terry_quality,
        op5_simhash_bk_components,
        op6_compression_toxicity,
        op7_stream_exact_dedup,
        op8_pfair_mix,
        op9_bpe_token_counts,
        op10_open_window_packing,
        op11_lobpcg_whitening,
        op12_prefix_doubling_repeats,
        op13_norm_bucket_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_stream_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS raw, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
            FROM documents
        ), r AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
}
