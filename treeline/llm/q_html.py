"""Query op8: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read
from treeline.llm.html import extract_main_text

NAME = "op8_template_class_extraction"
#: Parsing pages and deducing templates is beyond SQL; tests hold the query against planted pages.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
