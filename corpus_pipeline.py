"""A training corpus from `documents`: toxicity, language ID, near-duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame;
each result is written as Parquet to the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import bpe, language, mixing, simhash, toxicity
from quarryline.llm.common import ensure_checkpoint_dir, ship, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score as toxic. Null and empty texts score the base rate; repeated rows alike."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is known by its posterior, whichever it is. A text without words is known by declaration and source, or not at all."""
    ship(spark)
    return language.keep_languages(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of texts with SimHash fingerprints within 4 bits, by covering LSH, or similar shingle sets. Texts without words are one group; repeats of the kept row, id and text, all stay."""
    ship(spark)
    return simhash.drop_near_or_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each text and pass that takes words of it. Texts without words are never taken; null is a source of its own."""
    ship(spark)
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, and the token ids of each row; null counts as empty and has none."""
    ship(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source", "lang"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", simhash_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Learned models, connected components and token ids aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
