"""From raw documents to sampled token ids: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydropanel.llm import decontaminate, piece_lattice, quality_crf, secret_ledger, simhash
from hydropanel.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good; trained on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality_crf.train(docs.where(fold != 1), labels.where(fold != 1))
    return quality_crf.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles are linked by at most two differing bits."""
    return simhash.representatives(docs, shingle=3, radius=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret."""
    return secret_ledger.without_secrets(docs, secret_ledger.fresh_ledger(spark), path="doc_id", content="text")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One sampled segmentation of each document."""
    encoded = piece_lattice.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").alias("n_pieces"), "lossless", "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("pieces", pieces),
]

# Models and sampled segmentations are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
