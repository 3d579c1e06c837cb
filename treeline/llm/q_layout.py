"""Query op13: the documents' clustered layout and what file bounds let each row's query skip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read
from treeline.llm.layout import Dim, cluster, skipping
from treeline.llm.oracles import CRC_TABLE, crc32

NAME = "op13_radix_clustered_layout"
DIMS = [
    Dim("source", "source", text=True),
    Dim("lang", "lang", text=True),
    Dim("length", "coalesce(octet_length(text), -1)", radius=2),
    Dim("date", "crc32(cast(cast(doc_id AS string) AS binary)) % 365", radius=2),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skipping(cluster(read(spark, sf_dir, "documents"), DIMS), [d.radius for d in DIMS])
    bounds = F.concat_ws(",", *(F.col(f"{side}_{d}").cast("string") for d in range(len(DIMS)) for side in ("low", "high")))
    return found.select("doc_id", "z", "position", "file", "files_touched", "files_matching", bounds.alias("file_bounds"))


def _coordinate(value: str, name: str) -> str:
    return f"(16 * (rank() OVER (ORDER BY {value} NULLS FIRST) - 1) // count(*) OVER ()) AS {name}"


_Z = " + ".join(f"((({c} >> {bit}) & 1) << {4 * bit + 3 - d})" for bit in range(4) for d, c in enumerate(("s", "l", "n", "d")))
_BOUNDS = ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in ("s", "l", "n", "d"))
ORACLE = f"""
WITH tab AS ({CRC_TABLE}),
v AS (SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), -1) AS length, {crc32('doc_id::VARCHAR')} % 365 AS date FROM documents, tab),
c AS (SELECT doc_id, {_coordinate('encode(source)', 's')}, {_coordinate('encode(lang)', 'l')}, {_coordinate('length', 'n')}, {_coordinate('date', 'd')} FROM v),
z AS (SELECT *, ({_Z})::BIGINT AS z FROM c),
p AS (SELECT *, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1)::BIGINT AS position FROM z),
f AS (SELECT *, position // 1000 AS file FROM p),
b AS (SELECT file, {_BOUNDS} FROM f GROUP BY file),
q AS (SELECT DISTINCT z, s, l, n, d FROM f),
t AS (SELECT q.z, count(*)::BIGINT AS files_touched FROM q JOIN b ON q.s BETWEEN s0 AND s1 AND q.l BETWEEN l0 AND l1 AND n0 <= q.n + 2 AND n1 >= q.n - 2 AND d0 <= q.d + 2 AND d1 >= q.d - 2 GROUP BY q.z),
m AS (SELECT q.z, count(DISTINCT o.file)::BIGINT AS files_matching FROM q JOIN (SELECT DISTINCT file, s, l, n, d FROM f) o ON q.s = o.s AND q.l = o.l AND abs(q.n - o.n) <= 2 AND abs(q.d - o.d) <= 2 GROUP BY q.z)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)
"""
