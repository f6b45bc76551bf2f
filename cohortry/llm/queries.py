"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import alignment, chunk_codec, exact_dedup, hard_negatives, minhash, oracles, packing, pseudo_likelihood, quality_classifier, quality_rules, substring_dedup, token_counts, token_files, warc

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, folder))


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_codec.round_trip(_documents(spark, folder), WORD_BPE)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = token_counts.prefix_counts(_documents(spark, folder), WORD_BPE)
    n_tokens = F.element_at("counts", -1).cast("long")
    return tables.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > 2048).alias("over_limit"))


def op10_token_id_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    files = token_files.write_token_files(docs, WORD_BPE, end_id=2)
    return token_files.read_all(files, token_files.keys_of(docs)).drop("turn")


def op1_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(_documents(spark, folder))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut_pieces(_documents(spark, folder), BYTE_BPE, end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    archives = warc.write_archives(pages)
    records = warc.fetch(archives, warc.lookup(archives, pages), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.with_counts(_documents(spark, folder), BYTE_BPE, PIECE_BPE)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives.mine(spark.read.parquet(f"{folder}/embeddings.parquet"), label=label)


def queries() -> dict[str, Query]:
    return {
        "op1_pseudo_likelihood": op1_pseudo_likelihood,
        "op2_quality_rules": op2_quality_rules,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_bpe_round_trip": op8_bpe_round_trip,
        "op9_token_counts": op9_token_counts,
        "op10_token_id_output": op10_token_id_output,
        "op11_warc": op11_warc,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
