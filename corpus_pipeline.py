"""The corpus pipeline: five of the operators over ``documents``, each over all that the one before it kept.

Stages take (spark, docs, sf_dir).  Each but the last returns the columns of ``documents``; the last returns the
pieces of the packed sequences.  Each result is written as Parquet and read again.  A null text counts as empty and
stays; rows with equal id and text stay once; empty tables give empty results.  Sequences hold at most 4096 tokens and
64 documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import decontaminate, jaccard, packing, pii, runtime, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five words, similarity 0.8 or more): that with the smallest id."""
    return jaccard.drop_near_copies(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens."""
    cap = packing.Capacity(tokens=4096, documents=64, weights=(1.0, 0.05, 0.001))
    return packing.pack_documents(docs, tokens.public_path(), end_id=1, cap=cap)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: SQL has no tokenizer and no fitted grammar; ``tests/llm`` compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another."""
    runtime.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
