"""Query op1: all documents into forty shards under the law of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read
from treeline.llm.sharding import interleave

NAME, SHARDS, SEED = "op1_proportional_interleave_shards", 40, 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(read(spark, sf_dir, "documents"), SHARDS, seed=SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 is folded over the bytes with the usual table of the polynomial 0xEDB88320, built in place.
ORACLE = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab
), c AS (
  SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32) AS h FROM (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)::BIGINT AS text_crc32
  FROM documents, t)
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1
            + (('0x' || substr(md5('{SEED}' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS fraction
  FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, h, doc_id, text_crc32, size, source) - 1 AS position, count(*) OVER () AS n FROM r
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position * {SHARDS} // n)::INTEGER AS shard,
       (position - (position * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""
