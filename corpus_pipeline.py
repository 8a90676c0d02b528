"""Corpus cleaning and packing, stage by stage, over the given documents.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written and read again as
the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointlake.llm import decontamination, language, near, packing, toxicity
from pointlake.llm.text import table
from pointlake.workspace import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus' own labels teach; the rest has no letter or looks like none."""
    return language.keep_identified(docs, language.fit(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labels of those still here, does not call toxic."""
    chain = toxicity.label_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, one of the least id."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids and their places in sequences of 2048 tokens."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

# A trained network and a tokenizer decide; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
