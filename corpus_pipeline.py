"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near copies stays, sources
are mixed to their target weights, and what is left is packed into sequences.

Every stage works on all rows that the one before kept. Its rows are written as Parquet in the folder that executors
share and read again as the next one's documents, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mix, near, pack, queries, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op8 rejects go; it learns from the labelled ones that op8 learns from."""
    model = toxicity.train(docs.where(queries.remainder("doc_id", 5) != 0), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; a document that has lost all its lines stays, empty."""
    return lines.dedup_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that op10's fingerprints or MinHash bands bring together are near copies if they share four fifths of their five-word shingles, counted exactly."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mix.mixed_documents(docs, queries.quality_weights(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage's method can be said in SQL: tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; returns the last one's rows, read from where they were written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
