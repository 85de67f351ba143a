"""A corpus pipeline of five stages: each takes all documents its predecessor kept, as Parquet reread.

Defined results, for every stage: a null text counts as an empty one and stays null; rows without an id are
documents like others; other columns stay as they are, whatever their names; an empty table stays empty. Rows
repeated whole are scored, cleaned and decontaminated alike, and near_dedup keeps one of them. With no labelled
documents the classifier rejects none; packing gives every document, an empty one too, its end id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.decontaminate import decontaminated
from orrery.llm.lines import without_spread_lines
from orrery.llm.neardup import one_of_each
from orrery.llm.packing import pack
from orrery.llm.quality import good_documents
from orrery.llm.queries import tokenizer_path
from orrery.llm.session import ensure_checkpoint_dir, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share, but for the first occurrence."""
    return without_spread_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed training sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

# A trained classifier, LSH and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}_{name}")
        docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
