"""A corpus pipeline over five operators; each stage works on all that its predecessor kept.

``run`` writes every stage as Parquet to the shared folder that ``spark.checkpoint.dir`` names and reads it again, so a
lost executor costs at most the stage that it worked on.

Defined cases: documents with a null or empty text, or without a letter, go in the first stage; a null id, language or
source is a value like any other and its document passes; of repeated rows one stays; very long texts are read whole; an
empty table gives an empty result with the columns of the last stage; further columns of documents, whatever their names
(but for those that begin with the reserved prefix of the operators, which are refused), pass all stages but the last.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, dedup, langid, mixing, ngram_join
from tessella.llm.common import materialise, table
from tessella.llm.queries import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is in doubt, go."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that source, language and topic have their target weights."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [("language", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("bpe", encode)]

#: The language model, the near copies and the encoding have no form in SQL; tests/llm/test_pipeline.py holds the rows
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
