"""Query op3: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm.common import read
from treeline.llm.neardup import near_groups

NAME = "op3_fast_similarity_sketch_neardup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS r FROM d
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.r < link.b
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
