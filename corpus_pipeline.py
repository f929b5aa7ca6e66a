"""A training-corpus pipeline of five stages, each of which writes what it keeps for the next one.

Toxic documents go, one of each group of near copies stays, benchmark passages are cut out, secrets are
masked, and what is left is encoded. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import common, decontaminate, minhash, secrets, sentencepiece, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go. It learns from the labelled ones outside the held-out fold."""
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model, COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8), the one with the smallest id."""
    return minhash.drop_copies(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that cover a window of a benchmark item are cut out; a document that is mostly such spans goes."""
    return decontaminate.clean(docs.select(*COLUMNS), common.read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; no document goes."""
    return secrets.redact(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and pieces (ids) of every document that is left."""
    return sentencepiece.encode(docs).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", encoding_stage),
]

#: Learnt models, near copies and Viterbi encoding can't be told in SQL; a test holds the whole result against every
#: stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read back."""
    docs, folder = common.read(spark, sf_dir, "documents"), common.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), folder, f"{i}_{name}")
        if i:
            common.removed(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
