"""Inventories from elsewhere: SQLite databases, and JSON manifests with exact keys."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from treeline.operators.graph import RELATIONS
from treeline.operators.lineage import canonical

#: Fixed value: the type tag of an inventory database.
INVENTORY_ID = 1346654806
#: Rows that are read at a time.
CHUNK = 50_000


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, *, application_id: int | None = INVENTORY_ID, where: str = "1 = 1", folder: str | None = None) -> DataFrame:
    """A table of a SQLite file, opened read-only; another type tag raises.

    With ``folder`` (shared by all executors) rows go through Parquet files in chunks, so the driver holds one chunk.
    """
    columns = [c.split()[0] for c in schema.split(",")]
    db = sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True)
    try:
        db.execute("PRAGMA query_only = ON")
        found = db.execute("PRAGMA application_id").fetchone()[0]
        if application_id is not None and found != application_id:
            raise ValueError(f"{path} has type {found}, not {application_id}")
        rows = db.execute(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")
        if folder is None:
            return spark.createDataFrame(rows.fetchall(), schema)
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(folder)
        while chunk := rows.fetchmany(CHUNK):
            spark.createDataFrame(chunk, schema).write.mode("append").parquet(folder)
        return spark.read.schema(schema).parquet(folder)
    finally:
        db.close()


def latest_session(path: str) -> str:
    """The complete session that finished last."""
    db = sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True)
    try:
        row = db.execute("SELECT scan_session_id FROM scan_sessions WHERE state = 'COMPLETE' ORDER BY finished_at DESC, scan_session_id DESC LIMIT 1").fetchone()
    finally:
        db.close()
    if row is None:
        raise ValueError("no complete session")
    return row[0]


def read_manifest(path: str, keys: set[str]) -> dict:
    """A JSON object with exactly these keys, in canonical bytes with a newline at the end."""
    raw = Path(path).read_bytes()
    value = json.loads(raw)
    if not isinstance(value, dict) or set(value) != keys:
        raise ValueError(f"{path} must have the keys {sorted(keys)}")
    if raw != canonical(value) + b"\n":
        raise ValueError(f"{path} is not in canonical form")
    return value


def relations(spark: SparkSession, found: list[dict], evaluated: list[str]) -> DataFrame:
    """Declared relations as (evidence_id, source, target, relationship_type, confidence, directed), all rules checked."""
    if evaluated != sorted(set(evaluated)):
        raise ValueError("evaluated projects must be sorted and unique")
    rows, seen = [], set()
    for r in found:
        source, target, kind, confidence = r["source_project"], r["target_project"], r["relationship_type"], r["confidence"]
        if kind not in RELATIONS or isinstance(confidence, bool) or not isinstance(confidence, int | float) or not 0 <= confidence <= 1:
            raise ValueError(f"bad relation {r}")
        if source == target or source not in evaluated or target not in evaluated or (source, target, kind) in seen or (not RELATIONS[kind] and source > target):
            raise ValueError(f"bad ends of relation {r}")
        seen.add((source, target, kind))
        rows.append((r["evidence_id"], source, target, kind, float(confidence), int(RELATIONS[kind])))
    if [r[0] for r in rows] != sorted({r[0] for r in rows}):
        raise ValueError("evidence ids must be sorted and unique")
    return spark.createDataFrame(rows, "evidence_id string, source string, target string, relationship_type string, confidence double, directed int")
