"""A corpus pipeline of four stages over the documents table; each stage's decisions take effect before the next.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. The first three return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read, stash
from treeline.llm.decontamination import drop_contaminated
from treeline.llm.neardup import drop_near_duplicates
from treeline.llm.packing import pack
from treeline.llm.tokens import vocabulary
from treeline.llm.toxicity import drop_toxic, train

END_ID, CAPACITY, NEAR_PERCENT = 0, 2048, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, does not reject."""
    return drop_toxic(docs, train(docs, read(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; links are at a Jaccard similarity of 0.8."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are hit by the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of CAPACITY tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [
    ("reject toxic", reject_toxic),
    ("deduplicate", deduplicate),
    ("decontaminate", decontaminate),
    ("pack sequences", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
