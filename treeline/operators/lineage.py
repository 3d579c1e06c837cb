"""Canonical text, digests, runs and their verification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import hashtree

RUN_STATES = ("RUNNING", "COMPLETE", "FAILED", "STOPPED")


def canonical(value: object, *, ascii_only: bool = True) -> bytes:
    """Sorted keys, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def stream_digest(rows: Iterable[tuple]) -> str:
    """SHA-256 over one compact JSON list a line, in the order given."""
    h = hashlib.sha256()
    for row in rows:
        h.update(json.dumps(list(row), separators=(",", ":")).encode() + b"\n")
    return h.hexdigest()


def ordered_digest(df: DataFrame, *order: str) -> str:
    """:func:`stream_digest` of a table in the binary order of its keys, streamed through the driver a partition at a time."""
    return stream_digest(tuple(r) for r in df.orderBy(*order).toLocalIterator(prefetchPartitions=True))


def multiset_digest(df: DataFrame) -> str:
    """A digest that does not depend on order and needs no sort: counts, sums and exclusive ors of row hashes. Not the same as :func:`ordered_digest`."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return digest([str(v) for v in row])


def iso_micros(ns: int | None) -> str | None:
    """Nanoseconds as ISO text with microseconds; the seconds are a rounded double first."""
    return None if ns is None else datetime.fromtimestamp(ns / 1_000_000_000, UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


def export_lines(directories: DataFrame, files: DataFrame, errors: DataFrame, events: DataFrame) -> DataFrame:
    """(section, key, line) of the canonical export: header, directories, files, errors, events. Lines are raw UTF-8 JSON with sorted keys.

    ``events`` has event_id, event_type and detail_json. Other columns of the inputs become keys as they are.
    """
    spark = directories.sparkSession

    def lines(df: DataFrame, section: int, kind: str, key: list[str]) -> DataFrame:
        fields = sorted([*df.columns, "record_type"])
        body = F.to_json(F.struct(*(F.lit(kind).alias(c) if c == "record_type" else F.col(c) for c in fields)), {"ignoreNullFields": "false"})
        return df.select(F.lit(section).alias("section"), F.concat_ws("\x00", *(F.col(c).cast("string") for c in key)).alias("key"), body.alias("line"))

    head = spark.createDataFrame([(0, "", canonical({"record_type": "session", "schema": 2, "status": "COMPLETE"}).decode())], "section int, key string, line string")
    detail = F.format_string('{"detail":%s,"event_type":%s,"record_type":"event"}', F.col("detail_json"), F.to_json(F.struct(F.col("event_type").alias("e"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("event_type").alias("e")))) - 6))
    told = events.select(F.lit(4).alias("section"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("key"), detail.alias("line"))
    return head.unionByName(lines(directories, 1, "directory", ["relative_path"])).unionByName(lines(files, 2, "file", ["relative_path"])).unionByName(lines(errors, 3, "error", ["relative_path", "operation"])).unionByName(told)


def write_export(lines: DataFrame, path: str) -> tuple[str, int]:
    """Write the lines in order as one new file; (SHA-256, lines)."""
    h, n = hashlib.sha256(), 0
    with open(path, "xb") as out:
        for row in lines.orderBy("section", "key").toLocalIterator(prefetchPartitions=True):
            data = row["line"].encode() + b"\n"
            out.write(data)
            h.update(data)
            n += 1
    return h.hexdigest(), n


def write_receipt(value: dict, path: str) -> str:
    """Write canonical JSON with its own digest under ``receipt_digest``, to a new file only."""
    own = digest(value)
    with open(path, "xb") as out:
        out.write(canonical(value | {"receipt_digest": own}) + b"\n")
    return own


def read_receipt(path: str, keys: frozenset[str] | None = None) -> dict:
    """A receipt whose bytes, keys and digest hold."""
    with open(path, "rb") as f:
        raw = f.read()
    value = json.loads(raw)
    own = value.pop("receipt_digest", None)
    if own != digest(value) or raw != canonical(value | {"receipt_digest": own}) + b"\n" or (keys is not None and set(value) != keys):
        raise ValueError("the receipt does not hold")
    return value


class Artifact:
    """A folder of Parquet tables of one run, and a ledger that is written last: without it there is no run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, kind: str, tables: dict[str, DataFrame], *, run_id: str, inputs: dict[str, str], order: dict[str, tuple[str, ...]], finished_at: str) -> str:
        """Tables in the order given, each with the root of its hash tree as its stage's digest; the run's digest is over those. Fails where a run is already."""
        stages, before = [], digest(inputs)
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
            hashtree.hash_tree(self.table(name), list(order[name])).write.mode("errorifexists").parquet(self._tree(name))
            own = hashtree.root(self.spark.read.parquet(self._tree(name)))
            stages.append((name, before, own))
            before = own
        output = digest([s[2] for s in stages])
        rows = [(kind, run_id, "COMPLETE", finished_at, json.dumps(inputs, sort_keys=True), output, name, a, b, list(order[name])) for name, a, b in stages]
        self.spark.createDataFrame(rows, "kind string, run_id string, state string, finished_at string, inputs string, output_digest string, stage string, input_digest string, stage_digest string, row_order array<string>").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/_ledger")
        return output

    def _tree(self, name: str) -> str:
        return f"{self.path}/_trees/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def verify(self, kind: str) -> str:
        """Recompute every stage's hash tree in the executors; the run's digest, or an error that names the first changed range of rows."""
        rows = self.table("_ledger").collect()
        if not rows or any(r["kind"] != kind or r["state"] != "COMPLETE" for r in rows):
            raise ValueError(f"not a complete {kind} run")
        for r in rows:
            now = hashtree.hash_tree(self.table(r["stage"]), list(r["row_order"]))
            if hashtree.root(now) != r["stage_digest"]:
                at = hashtree.changed_ranges(self.spark.read.parquet(self._tree(r["stage"])), now).orderBy("idx").first()
                raise ValueError(f"stage {r['stage']} was changed after the run" + (f": {at['change']} from {at['old_first'] or at['new_first']!r} to {at['old_last'] or at['new_last']!r}" if at else ""))
        return rows[0]["output_digest"]


def require_same(**values: object) -> None:
    """Lineage checks: all named values must be equal."""
    if len({str(v) for v in values.values()}) > 1:
        raise ValueError(f"lineage differs: {values}")
