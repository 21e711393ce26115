"""A training corpus from documents: quality, near-duplicates, secrets, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.

Defined cases: a document without text, or with fewer than 50 words, fails the base rules and goes in the first stage; rows
without an id stay (they are in no class of near copies) and are packed under a null id; a row that repeats another's id and
text goes with the near copies, an id on two different texts stands for two documents; a null language or source is a group of
its own; sources without words get no copies; texts have no length limit; columns of any other name are carried along, also
those that operators use as names of results; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.checkpoints import shared_folder
from tidewell.llm import mixing, near_duplicates, packing, quality, secret_scan


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) one document stays."""
    return near_duplicates.keep_one(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and text lengths follow; no document goes."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mixture asks, each at least once if it has words."""
    return mixing.realise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", good_documents),
    ("near-duplicates", one_of_each),
    ("secret scan", without_secrets),
    ("source mixture", mixed_sources),
    ("packing", packed),
]

#: Near-duplicate classes of whole texts and a packing by blocks aren't SQL; the test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written in the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
