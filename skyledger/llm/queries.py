"""One query per operator of this package, over whole tables: ``name -> (spark, sf_dir)``."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import (
    decontaminate,
    extract,
    materialise,
    packing,
    quality,
    shards,
    simhash,
    spelling,
    substring,
    suffixes,
    tokens,
    tries,
    warc,
)
from skyledger.llm.frames import shipped
from skyledger.llm.oracle import ORACLE  # noqa: F401  next to the queries it checks

#: Vocabulary files of public tokenizers; set this to where they lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TRAINING_KEY = 20240229

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.substring_digest(docs).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.suffix_digest(docs).drop("text")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(TOKENIZERS, "byte_bpe_50k.tiktoken").read_bytes()
    return materialise.training_order(
        table(spark, sf_dir, "documents"), ranks, key=TRAINING_KEY
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, byte_fallback = tokens.read_vocabulary(str(Path(TOKENIZERS, "piece_bpe_32k.model")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, pieces, byte_fallback).drop("text")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_text(table(spark, sf_dir, "pages")).drop("html")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).drop("text", "gram_coverage")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs, noise=97)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_training_order": op6_training_order,
    "op7_token_counts": op7_token_counts,
    "op8_main_text": op8_main_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}
