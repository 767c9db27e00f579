"""A corpus pipeline: each stage reads what the one before has kept.

run() applies the stages to the documents table. All stages but the last return
the columns of documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagspace.llm import common, jaccard, packing, quality, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go.

    A null or empty text has no evidence against it and stays; repeated rows are judged alike; an empty table stays empty.
    """
    return toxicity.kept(docs, common.table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without a positive label to learn from, all stay.

    A null text is judged as the empty one; repeated rows are judged alike; an empty table stays empty.
    """
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays: that with the smallest id."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts; all documents stay."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs


#: Tokenizing, fitted models and packing can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
