"""Query op7: every document's ids written in binary files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read
from treeline.llm.token_output import read_index, write_ids
from treeline.llm.tokens import vocabulary

NAME, END_ID = "op7_context_mixing_ids", 1
#: A tokenizer is beyond SQL; tests hold the query against the library's own ids.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_index(write_ids(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID))
