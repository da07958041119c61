"""A corpus pipeline from the operators of ``lectern.llm``: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. Defined results for null, repeated and clashing input are
those of the operators; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import byte_bpe, fertility, mixing, simhash, toxicity
from lectern.llm.common import spent, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return fertility.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine calls toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixing.mixed_documents(docs)


def byte_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document of the mix."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding", byte_encoding),
]
#: Near-duplicate components, the fitted machine and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with spent(spark) as keep:  # what a stage wrote on the way goes once its result is stored
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{number}"))
    return STAGES[-1][1](spark, docs, sf_dir)
