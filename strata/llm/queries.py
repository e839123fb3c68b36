"""The queries of the training-data operators, each over the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import bytebpe, divergence, imi, jaccard, langid, mixing, phrases, quality, sharding, simhash, sketch, warc, wordbpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, h=2)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.with_neighbours(_table(spark, sf_dir, "documents"))


def op3_vector_bin_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).drop("record_id")


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(_table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_document_fingerprints,
        op3_vector_bin_sharding,
        op4_source_mixing,
        op5_prefix_token_counts,
        op6_byte_bpe_round_trip,
        op7_language_id,
        op8_quality_classifier,
        op9_arc_to_warc,
        op10_inverted_multi_index,
        op11_phrase_collocations,
        op12_source_divergence,
        op13_ngram_jaccard_join,
    )
}

#: DuckDB's SQL has none of XXH64, BPE, the trained models, bin packing and hypergeometric draws, and the
#: index's neighbours are approximate; those queries are tested against brute force.
SQL: dict[str, str] = {
    "op11_phrase_collocations": phrases.SQL,
    "op12_source_divergence": divergence.SQL,
    "op9_arc_to_warc": """
        with digested as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
        ), coded as (
            select page_id, payload_bytes, array_to_string([
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + (('0x' || substr(hex, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) % 32, 1)
                for i in range(32)], '') as payload_digest
            from digested
        ), firsts as (
            select payload_digest, min(page_id) as first_id from coded group by payload_digest
        )
        select page_id, payload_bytes, payload_digest,
               case when page_id > first_id then 'revisit' else 'response' end as record_type,
               case when page_id > first_id then first_id end as refers_to
        from coded join firsts using (payload_digest)
    """,
}
