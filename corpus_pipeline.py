"""A training-data pipeline of five operators, over the documents of a data folder.

Each stage takes what its predecessor kept, written as Parquet and read again: toxic
documents go, one document of each group of near copies stays, personal data is
replaced by its kind, sources are mixed to target weights (documents repeat), and every
text is encoded as sampled pieces.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmend.llm import minhash_dedup, mixing, piece_sampling, pii, toxicity
from textmend.llm.common import discard, stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by sets of five words; two words are the contract of op6's query alone."""
    return minhash_dedup.drop_near_duplicates(docs, shingle=5)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, samples (piece ids), and whether all samples decode to the text."""
    return piece_sampling.encode(docs, carry=["doc_id", "lang", "source"], verify=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: The learned scores, sampled hashes and segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = stage(out, f"pipeline-{name}")
            discard(before)
            before = out
        docs = out
    return docs
