"""Query op11: leaves, roots, proofs and tamper checks of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import merkle
from treeline.llm.common import ascii_lower, read
from treeline.llm.oracles import CRC_TABLE, crc32

NAME = "op11_merkle_preimage_paths"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = merkle.leaf_hash(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.COLUMNS))
    manifest = merkle.build(read(spark, sf_dir, "documents"), carry={"altered": F.when(hit, altered)})
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("chain"))
    out = merkle.ancestors(manifest).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("chain")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of a group's tree and of the tree over groups that the SQL below spells out; the operator has no such bound.
_INNER, _OUTER = 6, 4


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, key: str, levels: int) -> str:
    """CTEs name1..: a parent is (key, idx, run, h, n); nodes that are alone pass on as they are, with no run."""
    out = []
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} AS (SELECT {key}, idx // 16 AS idx, CASE WHEN any_value(n) > 1 THEN list(h ORDER BY idx) END AS run, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k - 1} GROUP BY {key}, idx // 16)"
        )
    return ", ".join(out)


def _others(run: str, idx: str) -> str:
    return f"CASE WHEN {run} IS NULL THEN '' ELSE array_to_string({run}[:{idx} % 16], '') || array_to_string({run}[{idx} % 16 + 2:], '') END"


def _fold(node: str, run: str, idx: str) -> str:
    return f"CASE WHEN {run} IS NULL THEN {node} ELSE sha256(array_to_string({run}[:{idx} % 16], '') || {node} || array_to_string({run}[{idx} % 16 + 2:], '')) END"


def _oracle() -> str:
    steps, last = [], "p0"
    for k in range(1, _INNER + _OUTER + 1):
        t, idx = (f"s{k}", f"(x.idx // {16 ** (k - 1)})") if k <= _INNER else (f"g{k - _INNER}", f"(x.gidx // {16 ** (k - _INNER - 1)})")
        met = f"t.source IS NOT DISTINCT FROM x.source AND t.idx = {idx} // 16" if k <= _INNER else f"t.idx = {idx} // 16"
        steps.append(f"p{k} AS (SELECT x.* EXCLUDE (sib, node), sib || {_others('t.run', idx)} AS sib, {_fold('node', 't.run', idx)} AS node FROM {last} x JOIN {t} t ON {met})")
        last = f"p{k}"
    return f"""
WITH tab AS ({CRC_TABLE}), l AS (
  SELECT doc_id, source, {_leaf('text')} AS h, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents, tab
), s0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l
), {_tree('s', 'source', _INNER)}, g0 AS (
  SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM s{_INNER}
), {_tree('g', 'one', _OUTER)}, p0 AS (
  SELECT s0.doc_id, s0.source, s0.h AS leaf, g0.h AS subroot, s0.idx, g0.idx AS gidx, '' AS sib, coalesce(s0.altered, s0.h) AS node FROM s0 JOIN g0 ON s0.source IS NOT DISTINCT FROM g0.source
), {', '.join(steps)}
SELECT doc_id, leaf, subroot, (SELECT h FROM g{_OUTER}) AS root, sha256(sib) AS proof_sha256, node AS folded_root, node = (SELECT h FROM g{_OUTER}) AS verified FROM {last}
"""


ORACLE = _oracle()
