"""Inventory-shaped views over the sample tables.

The same SQL text runs here and in the oracle: ``{documents}`` and its like are filled in with a DataFrame or with
the name of a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths

#: Files as documents, extensions by key, and special places so that every role rule has files.
_PLACED = """
SELECT doc_id, source, lang, n_chars, doc_id % 50 AS k,
       CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.wav' ELSE '.bin' END AS ext
FROM {documents}
"""
_PATHS = f"""
SELECT doc_id, CAST(n_chars AS BIGINT) AS logical_bytes,
       source || '/' || lang || '/' || CASE k
         WHEN 7 THEN 'proj_' || doc_id || '/pyproject.toml'
         WHEN 8 THEN '.venv/doc_' || doc_id || ext
         WHEN 9 THEN 'build/doc_' || doc_id || ext
         WHEN 10 THEN 'final exports/doc_' || doc_id || '.wav'
         WHEN 11 THEN '.cache/doc_' || doc_id || ext
         WHEN 12 THEN 'doc_' || doc_id || '.zip'
         WHEN 13 THEN 'doc_' || doc_id || '.exe'
         ELSE 'doc_' || doc_id || ext END AS relative_path
FROM ({_PLACED}) placed
UNION ALL
SELECT doc_id, CAST(1 AS BIGINT), source || '/' || lang || '/proj_' || doc_id || '/sub/package.json' FROM {{documents}} WHERE doc_id % 100 = 7
"""
#: ``{{k}}`` is the snapshot, -1 for the plain inventory.
FILES = f"""
SELECT relative_path, regexp_replace(relative_path, '/[^/]+$', '') AS parent_path, regexp_extract(relative_path, '([^/]+)$', 1) AS name,
       regexp_extract(regexp_extract(relative_path, '([^/]+)$', 1), '^.+([.][^./]+)$', 1) AS extension, 'FILE' AS entry_type,
       logical_bytes + CASE WHEN doc_id % 11 = {{k}} THEN 1 ELSE 0 END AS logical_bytes,
       1704067200000000000 + doc_id * 1000000000 + CASE WHEN doc_id % 11 = {{k}} THEN {{k}} ELSE 0 END AS modified_ns,
       CAST(0 AS BIGINT) AS attributes, CAST(length(relative_path) - length(replace(relative_path, '/', '')) + 1 AS BIGINT) AS depth, 'OBSERVED' AS observation_status, doc_id
FROM ({_PATHS}) paths WHERE doc_id % 17 <> {{k}}
"""
#: Scan errors of snapshot {{k}}.
ERRORS = "SELECT source || '/' || lang AS relative_path, 'enumerate' AS operation, 'PermissionError' AS error_type FROM {documents} GROUP BY source, lang HAVING min(doc_id) % 13 = {k}"
#: Decisions that users took on directories, from the event table.
DECISIONS = """
SELECT 'src' || (user_id % 20) || '/' || CASE event_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS relative_path,
       CASE event_type WHEN 'view' THEN 'UNKNOWN' WHEN 'click' THEN 'ARCHIVE_ELIGIBLE' WHEN 'purchase' THEN 'KEEP' WHEN 'signup' THEN 'PROJECT_BOUNDARY' ELSE 'PROTECT' END AS decision,
       ts, event_id
FROM {events}
"""
#: A large inventory from orders: year/month/status/priority/o_key.dat.
BENCH_FILES = """
SELECT substr(CAST(o_orderdate AS STRING), 1, 4) || '/' || substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || o_orderstatus || '/' || o_orderpriority || '/o_' || o_orderkey || '.dat' AS relative_path,
       CAST(floor(o_totalprice) AS BIGINT) AS logical_bytes
FROM {orders}
"""
#: Flat page paths: host and path of the URL.
URL_FILES = """
SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS relative_path FROM {pages}
"""
#: A dependency graph of nations: customers' nations on suppliers', the three heaviest targets each.
EDGES = """
SELECT source, target, CAST(n AS DOUBLE) / CAST(max(n) OVER () AS DOUBLE) AS confidence FROM (
  SELECT source, target, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS place FROM (
    SELECT cn.n_name AS source, sn.n_name AS target, count(*) AS n
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey
         JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey
    WHERE cn.n_nationkey <> sn.n_nationkey GROUP BY cn.n_name, sn.n_name) pairs) ranked
WHERE place <= 3
"""
#: Relations of projects: a project holds those nested in it, and each names the one with half its number.
PROJECT_EDGES = """
SELECT source, target, relationship_type, CAST(1 AS DOUBLE) AS confidence FROM (
  SELECT a.relative_path AS source, b.relative_path AS target, 'NESTED_PROJECT' AS relationship_type
  FROM {projects} b JOIN {projects} a ON a.relative_path || '/sub' = b.relative_path
  UNION ALL
  SELECT a.relative_path, b.relative_path, 'DEPENDS_ON'
  FROM (SELECT relative_path, CAST(regexp_extract(relative_path, 'proj_([0-9]+)$', 1) AS BIGINT) AS n FROM {projects} WHERE relative_path NOT LIKE '%/sub') a
  JOIN (SELECT relative_path, CAST(regexp_extract(relative_path, 'proj_([0-9]+)$', 1) AS BIGINT) AS n FROM {projects} WHERE relative_path NOT LIKE '%/sub') b
    ON b.n = 7 + 50 * CAST(floor((a.n - 7) / 100) AS BIGINT) AND b.n < a.n) related
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, k: int | None = None) -> DataFrame:
    text = sql if k is None else sql.replace("{k}", str(k))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def files(spark: SparkSession, sf_dir: str, k: int = -1) -> DataFrame:
    return _run(spark, sf_dir, FILES, "documents", k=k)


def errors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _run(spark, sf_dir, ERRORS, "documents", k=k)


def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on directories that exist."""
    known = directories(files(spark, sf_dir))
    return _run(spark, sf_dir, DECISIONS, "events").join(known, "relative_path", "left_semi")


def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, BENCH_FILES, "orders")


def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, URL_FILES, "pages")


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, EDGES, "lineitem", "orders", "customer", "nation", "supplier")


def sized_files(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Snapshot k with the sizes of its texts in bytes, so that no selection of content holds more than its directory."""
    octets = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("octets"))
    size = F.when(F.col("name") == "package.json", F.lit(1).cast("long")).otherwise(F.col("octets")) + F.when(F.col("doc_id") % 11 == k, 1).otherwise(0)
    return files(spark, sf_dir, k).join(octets, "doc_id").withColumn("logical_bytes", size).drop("octets")


def project_edges(projects: DataFrame) -> DataFrame:
    """(source, target, relationship_type, confidence) of projects (relative_path)."""
    return projects.sparkSession.sql(PROJECT_EDGES, projects=projects)


def directories(file_rows: DataFrame) -> DataFrame:
    """(relative_path): every directory above a file, without the root. Parents are made distinct before they are expanded."""
    parents = file_rows.select(paths.parent("relative_path").alias("p")).where("p is not null").distinct()
    return parents.select(F.explode(paths.ancestors("p", root=False, itself=True)).alias("relative_path")).distinct()
