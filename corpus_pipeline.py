"""The corpus pipeline: clean, deduplicate and pack `documents`.

Each stage is a function (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs. All
stages but the last keep the columns of docs. Null texts are empty documents; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import fresh_path, remove, scratch, table
from sluice.llm.exact_dedup import exact_dedup
from sluice.llm.labelled import fold
from sluice.llm.near_dedup import near_dedup
from sluice.llm.packing import pack_documents
from sluice.llm.quality import fit_quality, score_quality
from sluice.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; learned from the labels outside the held-out fold."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).where("score < 0.5").select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score less than 0.5; learned from the labels outside the held-out fold."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score_quality(docs, model).where("score >= 0.5").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least doc_id stays."""
    return near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Trained models, tokenizers and components have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage's table goes once the next is written, and what a stage has written on its way with it."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        for old in written:
            remove(spark, old)
        written = [path]
    return docs
