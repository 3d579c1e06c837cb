"""Query op4: a verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read
from treeline.llm.url_filter import judge, parse_rule

NAME = "op4_url_boosted_trees"
RULES = [
    parse_rule("com/en/", "block"),
    parse_rule("example.com/en/7", "allow"),
    parse_rule("net/de/", "allow"),
    parse_rule("example.net/de/8", "block"),
    parse_rule("org/es/", "block"),
]
#: Boosted trees are beyond SQL; tests hold the rules' part against SQL and the trees against held-out rules.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")
