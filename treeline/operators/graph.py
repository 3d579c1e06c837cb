"""Graphs of projects: components, degrees, PageRank."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.store import cut, ship, written

#: Edges up to which PageRank runs in the driver's memory; beyond, it runs as joins.
DRIVER_EDGES = 200_000
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-12
#: Relation types, and which of them have a direction.
RELATIONS = {"DEPENDS_ON": True, "REFERENCES": True, "GENERATED_FROM": True, "EXPORTS_TO": True, "SHARES_ASSETS_WITH": False}


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, distinct, without loops."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reached. Labels go along edges and then along themselves until they rest."""
    both = written(undirected(edges))
    labels = written(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = written(step.join(far, "root", "left").select("node", "old", F.coalesce("far", "root").alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels


def component_ids(labels: DataFrame) -> DataFrame:
    """(node, component_id, size): the first 16 hex digits of SHA-256 of the JSON list of sorted members."""

    ship(labels.sparkSession)

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf["node"])
        digest = hashlib.sha256(json.dumps(members, separators=(",", ":")).encode()).hexdigest()[:16]
        return pd.DataFrame({"node": members, "component_id": digest, "size": len(members)})

    return labels.groupBy("root").applyInPandas(named, "node string, component_id string, size long")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours."""
    found = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(found, "node", "left").na.fill(0, ["degree"])


def dependency_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree and weight over DEPENDS_ON, and distinct neighbours over every type.

    ``edges`` are (source, target, relationship_type, confidence).
    """
    depends = edges.where("relationship_type = 'DEPENDS_ON'")
    side = lambda c, n: depends.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias(f"{n}_degree"), F.sum("confidence").alias(f"weighted_{n}"))
    rows = degrees(nodes, edges).withColumnRenamed("degree", "relationship_degree").join(side("target", "in"), "node", "left").join(side("source", "out"), "node", "left")
    return rows.na.fill(0, ["in_degree", "out_degree"]).na.fill(0.0, ["weighted_in", "weighted_out"])


def _ranks(names: list[str], pairs: list[tuple[str, str]]) -> np.ndarray:
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    source, target = (np.array([at[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
    out = np.bincount(source, minlength=n)
    rank = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        new = (1 - DAMPING) / n + DAMPING * (rank[out == 0].sum() / n + np.bincount(target, weights=share[source], minlength=n))
        rest, rank = np.abs(new - rank).max(), new
        if rest < TOLERANCE:
            break
    return rank


def pagerank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, pagerank) over DEPENDS_ON edges, unweighted; nodes without out-edges give to all alike.

    A node counts once however often it is there; edges with an end that is no node are left out; an edge that is there
    twice counts twice. Up to DRIVER_EDGES both in number the ranks are made in the driver, beyond by joins, alike.
    """
    nodes = cut(nodes.select("node").where("node IS NOT NULL").distinct())
    ends = [nodes.select(F.col("node").alias(c)) for c in ("source", "target")]
    depends = cut(edges.where("relationship_type = 'DEPENDS_ON'").select("source", "target").join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi"))
    spark = nodes.sparkSession
    if depends.count() <= DRIVER_EDGES and nodes.count() <= DRIVER_EDGES:
        names = sorted(r[0] for r in nodes.collect())
        ranks = _ranks(names, [(r["source"], r["target"]) for r in depends.collect()]) if names else []
        return spark.createDataFrame([(n, float(r)) for n, r in zip(names, ranks, strict=True)], "node string, pagerank double")
    n = nodes.count()
    out = depends.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    rank = cut(nodes.select("node", F.lit(1.0 / n).alias("pagerank")).join(out, "node", "left"))
    for _ in range(ROUNDS):
        loose = rank.where("out IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
        given = depends.join(rank.select(F.col("node").alias("source"), (F.col("pagerank") / F.col("out")).alias("share")), "source").groupBy(F.col("target").alias("node")).agg(F.sum("share").alias("got"))
        base = (1 - DAMPING) / n + DAMPING * loose / n
        new = cut(rank.join(given, "node", "left").select("node", "out", F.col("pagerank").alias("old"), (F.lit(base) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("pagerank")))
        rest = new.agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
        rank = new.select("node", "out", "pagerank")
        if rest < TOLERANCE:
            break
    return rank.select("node", "pagerank")


def check_relations(edges: DataFrame) -> DataFrame:
    """``edges`` with ``directed`` (0 or 1); an unknown type, a loop or a wrong order of undirected ends raises."""
    known = F.create_map(*(F.lit(x) for k, v in RELATIONS.items() for x in (k, int(v))))
    directed = known[F.col("relationship_type")]
    bad = directed.isNull() | (F.col("source") == F.col("target")) | ((directed == 0) & (F.col("source") > F.col("target")))
    return edges.withColumn("directed", F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("bad relation:"), "source", "relationship_type", "target"))).otherwise(directed))
