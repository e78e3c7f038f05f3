"""The corpus pipeline: documents in, sharded documents out, in stages written and read again between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewise.llm.common import table
from casewise.llm.decontaminate import keep_clean
from casewise.llm.jaccard_join import keep_one_row_of_each
from casewise.llm.language import keep_known_language
from casewise.llm.mixing import mixed_documents
from casewise.llm.sharding import shard
from casewise.session import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every learned language, go."""
    return keep_known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id."""
    return keep_one_row_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives the prefix of a seeded order that fills its part of the budget."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document left."""
    return shard(docs)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

# Hyperdimensional vectors cannot be written in SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows to the shared folder and the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Scratch(stage(spark, docs, sf_dir), name.replace(" ", "-")).frame
    return STAGES[-1][1](spark, docs, sf_dir)
