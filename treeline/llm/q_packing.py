"""Query op5: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read
from treeline.llm.packing import pack
from treeline.llm.tokens import vocabulary

NAME, END_ID, CAPACITY = "op5_configuration_program_packing", 0, 2048
#: A tokenizer is beyond SQL; tests hold the query against the library's own ids and the rules of packing.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)
