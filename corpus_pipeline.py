"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again for the next one.

Null and empty texts are scored, deduplicated and packed as texts without a
word; rows without or with a repeated id are documents each; an empty table
gives an empty one; columns beside those of ``documents`` pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm import decontaminate, lines, packing, quality, similar
from quadrill.llm.queries import byte_bpe, table
from quadrill.llm.store import materialise, small_batches, spare_name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones (a score of one half or more)."""
    small_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=True)
    return scored.where(F.col(spare_name(docs, "score")) >= 0.5).drop(spare_name(docs, "score"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less repeated chunks, and their new lengths; a document of nothing else goes."""
    removed = F.col(spare_name(docs, "n_removed"))
    left = lines.dedup(docs).where((removed == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spare_name(docs, "n_removed"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    small_batches(spark)
    return similar.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their token ids and their places in sequences of 1024 tokens and 64 documents at most."""
    small_batches(spark)
    return packing.pack_documents(docs, byte_bpe(), capacity=packing.Capacity(documents=64), with_ids=True, most_kept=400_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
