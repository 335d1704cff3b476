"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_main, impacts, mixing, order_minhash, packing, secrets, simhash, substrings, tiers, toxicity, vector_codes, vectors
from tidemark.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takings(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    packed = packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    digests = {f"{c}_sha256": F.sha2(c, 256) for c in ("ids", "positions")}
    return packed.withColumns(digests).drop("ids", "positions")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.drop("label").withColumn("codebooks_sha256", F.lit(books.digest()))


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tiers.read_model(public_tokenizers.path("word_bpe_49k.json"))
    return tiers.pack(table(spark, sf_dir, "documents"), model).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_tier_packing": op12_tier_packing,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE_SQL, "op11_vector_codes": vector_codes.ORACLE_SQL, "op13_lexical_search": impacts.ORACLE_SQL}
