"""Query op2: toxicity of every document by the classifier chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read
from treeline.llm.toxicity import score, train

NAME = "op2_toxicity_classifier_chain"
#: Trained models are beyond SQL; tests measure held-out accuracy.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
