"""The operators applied to whole tables, as the driver asks for them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbeam.llm import (
    ann,
    best_fit,
    circulant,
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    pieces,
    prefix_trie,
    sharding,
    surrogates,
    token_output,
    toxicity,
    url_filter,
)
from ledgerbeam.llm.common import read_table
from ledgerbeam.llm.oracles import ORACLES
from ledgerbeam.llm.params import SHARDS, SURROGATE_KEY, URL_RULES, tokenizer_path


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents")).drop("row_hash")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.progressive_dedup(
        read_table(spark, sf_dir, "documents"), hash_all=True
    ).drop("row_hash")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = token_output.packed_matrices(
        read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")
    )
    return packed.select(
        "sequence_id",
        "n_tokens",
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("positions").alias("positions_crc32"),
    )


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY, "entities")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(
        read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    )


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(
        read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations")).drop("screened")


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = circulant.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_learned_partitions": op1_learned_partitions,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_token_output": op6_token_output,
        "op7_surrogates": op7_surrogates,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_piece_codec": op9_piece_codec,
        "op10_sharding": op10_sharding,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_circulant_minhash": op12_circulant_minhash,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
