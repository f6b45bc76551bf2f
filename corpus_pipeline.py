"""The corpus pipeline: stages in order, each reading what the one before has written.

Documents that the classifier rejects go, then exact copies, then near copies, then passages that an earlier
document has; what is left is packed into sequences. Each stage judges its own input. Rows without a doc_id
go through: they are scored and may be exact copies, but are never near copies and lose no passages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import exact_dedup, minhash, packing, quality_classifier, substring_dedup
from cohortry.llm.storage import stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.classify(docs, labels, carry=docs.columns)
    return scored.filter("predicted = 1").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    copies = exact_dedup.exact_duplicates(docs).filter("NOT kept").select("doc_id", "text_sha256").distinct()
    sha256 = F.sha2(exact_dedup.normalised(docs["text"]).cast("binary"), 256)
    return docs.join(copies, docs["doc_id"].eqNullSafe(copies["doc_id"]) & (sha256 == copies["text_sha256"]), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest doc_id."""
    copies = minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; a text that loses none stays as it is."""
    cut = substring_dedup.remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars"))}
    return cut.select([(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.{c}")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences of that size."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

# a learnt model and a tokenizer take part: no SQL says the same
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
