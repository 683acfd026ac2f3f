"""Corpus pipeline over ``documents``: each stage keeps, drops or rewrites rows for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightledger.llm import base as B, minhash, packing, secrets, substring, toxicity


NEAR = 80  # percent of common five-word shingles from which a document is a near copy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay as they are."""
    B.ready(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < toxicity.REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    B.ready(spark)
    return minhash.keep_one(docs, NEAR)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat lose their words; a text that loses none stays as it is."""
    B.ready(spark)
    out = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _counted(out.withColumn("text", text), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the rest of every text stays."""
    B.ready(spark)
    return _counted(secrets.redact(docs, *secrets.fit(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    B.ready(spark)
    return packing.pack(docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

# The stages train models and tokenize, which SQL cannot express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = B.table(docs)
    return docs
