"""Query op12: secrets in every document, by a ledger of blobs that starts empty."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read, remove_at_exit
from treeline.llm.secret_scan import BASE, RULES, Ledger, report, scan
from treeline.store import shared_folder

NAME = "op12_secret_blob_ledger"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(rule: int) -> Callable[[Column], Column]:
    return lambda s: s["rule"] == rule


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ledger = Ledger(spark, f"{shared_folder(spark)}/treeline-secret-ledger-{uuid.uuid4().hex}")
    remove_at_exit(spark, ledger.path)
    scan(docs, ledger)
    found = report(docs, ledger)
    counts = [F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans(i: int) -> str:
    """A list of (start, rule, end) of rule ``i``'s matches in t."""
    r = RULES[i]
    p = r.pattern.replace("'", "''")
    found, tested, gaps = f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {r.group})", f"string_split_regex(t, '{p}')"
    end = f"list_sum(list_transform({gaps}[:k], lambda x: length(x))) + list_sum(list_transform({found}[:k], lambda x: length(x)))"
    return f"list_transform(list_filter(range(1, len({found}) + 1), lambda k: length({tested}[k]) >= {r.least}), lambda k: {{'start': ({end} - length({found}[k]))::INTEGER, 'rule': {i}, 'end': ({end})::INTEGER}})"


_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_JOIN = f"array_to_string(list_transform({{0}}, lambda s: {_KINDS}[s.rule + 1] || ':' || s.start || ':' || s.end), ',')"
ORACLE = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, list_sort({' || '.join(_spans(i) for i in range(len(RULES)))}) AS spans FROM b)
SELECT doc_id, {', '.join(f"len(list_filter(spans, lambda s: s.rule = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))},
       sha256({_JOIN.format(f'list_filter(spans, lambda s: s.rule < {len(BASE)})')}) AS base_sha256, {_JOIN.format('spans')} AS spans
FROM x
"""
